"""Ranked lexical search over bit-sliced Bloom signatures.

``build_index`` reads the texts once. Documents with a similar number of distinct terms share blocks; a block holds a
bitmap with one column per document and one row ("slice") per hash value: a term sets a few rows in its document's
column, and so does (term, level) for every level of occurrences the term reaches. A row of the block thus tells for all
its documents at once whether a term may occur that often; it is never wrong about absence.

``search`` reads the blocks. Slices are weighed by what a term can add to the score at its level, and their sum is an
upper bound for every document of the block. Documents whose bound reaches the score that is needed are scored exactly
from their stored term counts; no other document can be among the best. The score needed rises as a task goes on, and
starts from what a share of the blocks, searched first, already reaches. That only saves work: results are exact.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import narrow, pieces, register, table, text_bytes
from arbora.llm.shingles import mix, word_hashes
from arbora.session import materialize, scratch_root

TOP = 20
#: Signature bits per entry, rows that an entry sets, and the occurrences from which a level is entered.
BITS = 12
ROWS = 4
LEVELS = (1, 2, 4, 8)
#: Cells of one block's bitmap (rows × documents), and the most documents of a block.
CELLS = 1 << 22
MAX_DOCS = 4096
#: Distinct terms after which a task writes a piece of the dictionary.
DICTIONARY = 1 << 19
#: One block in so many is searched first.
SEED_SHARE = 16
#: Queries are answered in blocks of so many items, or terms if they are long.
ITEMS = 512
TERMS = 1 << 17
#: Bounds (terms × documents) that a task holds at a time.
BOUNDS = 1 << 20
#: Texts, and rows of the index (some MB each), that go to a Python worker at a time.
TEXT_ROWS = 512
BLOCK_ROWS = 1

# Everything in ASCII but letters and digits separates terms.
BREAKS = np.ones(256, bool)
BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
INDEX = ("kind string, bits int, ids array<long>, sizes array<long>, slices binary, ends binary, terms binary, "
         "counts binary")
ANSWER = "item_id long, rank int, doc_id long, score long"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SCHEMA = pa.schema([("kind", pa.string()), ("bits", pa.int32()), ("ids", pa.list_(pa.int64())),
                     ("sizes", pa.list_(pa.int64())), ("slices", pa.binary()), ("ends", pa.binary()),
                     ("terms", pa.binary()), ("counts", pa.binary())])


@dataclass
class LexicalIndex:
    """Blocks of documents and pieces of the dictionary in one Parquet table, apart by ``kind``."""

    spark: SparkSession
    path: str

    def part(self, *kinds: str) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(self.path).where(F.col("kind").isin(*kinds))


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: terms with repeats, end of its distinct terms; then all distinct term hashes and their counts."""
    hashes, sizes = word_hashes(*text_bytes(texts), BREAKS)
    ends = np.cumsum(sizes)
    new = np.ones(len(hashes), bool)
    for a, b in zip(ends - sizes, ends):
        hashes[a:b].sort()
    new[1:] = hashes[1:] != hashes[:-1]
    new[(ends - sizes)[sizes > 0]] = True
    at = np.flatnonzero(new)
    return sizes, np.searchsorted(at, ends), hashes[at], np.diff(np.append(at, len(hashes)))


def _rows(terms: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The rows (n, ROWS) that entries set in a bitmap of 2^bits rows."""
    h = mix(terms + np.uint64(level * 0xD1B54A32D192ED03 % (1 << 64)))
    step = h >> np.uint64(32) | np.uint64(1)
    return (h[:, None] + np.arange(ROWS, dtype=np.uint64) * step[:, None] & np.uint64((1 << bits) - 1)).astype(np.int64)


def _bits(entries: int) -> int:
    return max(6, int(np.ceil(np.log2(max(1, BITS * entries)))))


def _block(bits: int, docs: list[tuple]) -> dict:
    """One block: docs are (id, size, terms, counts)."""
    grid = np.zeros((1 << bits, -(-len(docs) // 8) * 8), bool)
    for d, (_, _, terms, counts) in enumerate(docs):
        for level, least in enumerate(LEVELS):
            at = terms if level == 0 else terms[counts >= least]
            if not len(at):
                break
            grid[_rows(at, level, bits).ravel(), d] = True
    first = docs[0]
    lot = int(mix(first[2][:1] + np.uint64(first[1]))[0] >> np.uint64(40))
    return {"kind": "seed" if lot % SEED_SHARE == 0 else "block", "bits": bits, "ids": [d[0] for d in docs],
            "sizes": [d[1] for d in docs], "slices": np.packbits(grid, axis=1).tobytes(),
            "ends": np.cumsum([len(d[2]) for d in docs]).astype(np.int64).tobytes(),
            "terms": np.concatenate([d[2] for d in docs]).tobytes(),
            "counts": np.concatenate([d[3] for d in docs]).astype(np.int64).tobytes()}


@contextmanager
def _batches_of(spark: SparkSession, rows: int):
    """What runs inside hands at most ``rows`` rows at a time to a Python worker; more would be held by both sides."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _one(row: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=_SCHEMA)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[int, list] = {}
    heard, n_heard = [], 0  # terms of documents, not yet in a dictionary piece

    def merged():
        terms = np.concatenate([t for t, _ in heard])
        order = np.argsort(terms, kind="stable")
        terms, counts = terms[order], np.concatenate([c for _, c in heard])[order]
        at = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        return terms[at], np.add.reduceat(counts, at)

    def piece():
        terms, counts = merged()
        return _one({"kind": "terms", "terms": terms.tobytes(), "counts": counts.tobytes()})

    for whole in batches:
        for batch in pieces(whole):
            sizes, ends, terms, counts = term_counts(batch.column("text"))
            for i, (row_id, size, end) in enumerate(zip(batch.column("id").to_pylist(), sizes.tolist(), ends.tolist())):
                begin = int(ends[i - 1]) if i else 0
                if end == begin:
                    continue
                own, tf = terms[begin:end], counts[begin:end]
                bits = _bits(sum(int((tf >= least).sum()) for least in LEVELS))
                block = waiting.setdefault(bits, [])
                block.append((row_id, size, own.copy(), tf.copy()))
                if len(block) >= min(MAX_DOCS, max(1, CELLS >> bits)):
                    yield _one(_block(bits, waiting.pop(bits)))
            if len(terms):
                heard.append((terms, np.ones(len(terms), np.int64)))
                n_heard += len(terms)
                if n_heard > 2 * DICTIONARY:
                    heard = [merged()]
                    n_heard = len(heard[0][0])
                    if n_heard > DICTIONARY:
                        yield piece()
                        heard, n_heard = [], 0
    for bits, docs in waiting.items():
        yield _one(_block(bits, docs))
    if heard:
        yield piece()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> LexicalIndex:
    """Write the index of all rows of ``docs`` to ``path`` (by default a new folder beside the lineage cuts).

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case, told apart by 64-bit hashes.
    A row without terms (null and empty texts) is in no block. Ids may repeat or be null: every row is a document.
    """
    path = path or os.path.join(scratch_root(docs.sparkSession), f"lexical-{uuid.uuid4().hex}")
    rows = narrow(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string"))
    # Small row groups: writer and reader hold a whole one, and a block is up to a few MB, so its size is looked at after each row.
    small = {"parquet.block.size": 4 << 20, "parquet.page.size.row.check.min": 1}
    with _batches_of(docs.sparkSession, TEXT_ROWS):
        rows.mapInArrow(_index, INDEX).write.partitionBy("kind").options(**small).parquet(path)
    return LexicalIndex(docs.sparkSession, path)


@dataclass
class _Queries:
    """A block of items: their distinct terms' weights, and of each item the places and repeats of its terms."""

    weights: np.ndarray
    terms: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]
    n: int
    total: int


def _read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, ends, terms, counts = term_counts(batch.column("text"))
        cuts = np.append(0, ends)
        yield pa.record_batch(
            [batch.column("id"), pa.array([terms[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
             pa.array([counts[a:b].astype(np.int64).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
            names=["id", "terms", "counts"])


def _saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _bounds(q: _Queries, slices: np.ndarray, bits: int, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What each distinct term (rows) adds at most to the score of each document (columns), per unit of its weight.

    All numbers are whole and below 2^53, so sums of doubles are exact.
    """
    out = np.zeros((len(q.terms), len(sizes)))
    there, reached = np.arange(len(q.terms)), np.zeros(len(sizes), np.int64)
    for level, least in enumerate(LEVELS):
        rows = _rows(q.terms[there], level, bits)
        hit = slices[rows[:, 0]]
        for k in range(1, ROWS):
            hit &= slices[rows[:, k]]
        some = hit.any(axis=1)
        there, hit = there[some], hit[some]
        if not len(there):
            break
        # A document that is not entered at the next level holds the term fewer times than that.
        most = np.minimum(sizes, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else sizes
        gain = _saturated(most, m)
        out[there] += np.unpackbits(hit, axis=1, count=len(sizes)) * (np.maximum(gain, reached) - reached).astype(float)
        reached = np.maximum(gain, reached)
    return out


def _search(shared, needed, top: int):
    """For each item the best documents of a task's blocks, by exact score; ``needed``: scores below are not asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: _Queries = shared.value
        least = needed.copy()
        best: list[list[tuple]] = [[] for _ in q.items]

        def score_best(i, lo, most, ids, ends, terms, counts, m):
            """The documents from ``lo`` on, whose bounds for item i are ``most``, as far as they may be among the best."""
            places, weights = q.items[i]
            order = np.flatnonzero(most >= max(1, least[i]))
            order = order[np.argsort(-most[order], kind="stable")]
            for bound, d in zip(most[order].tolist(), (order + lo).tolist()):
                if bound < least[i]:
                    break
                own = terms[ends[d]:ends[d + 1]]
                at = np.minimum(np.searchsorted(own, q.terms[places]), len(own) - 1)
                tf = counts[ends[d]:ends[d + 1]][at] * (own[at] == q.terms[places])
                score = int((weights.astype(np.int64) * _saturated(tf, m[d])).sum())
                if score < max(1, least[i]):
                    continue
                best[i].append((-score, ids[d] is None, ids[d] or 0))
                if len(best[i]) >= 2 * top or len(best[i]) == top:
                    best[i] = sorted(best[i])[:top]
                    least[i] = max(least[i], -best[i][-1][0])

        for batch in batches:
            for row in range(batch.num_rows):
                cell = {c: batch.column(c)[row] for c in ("bits", "ids", "sizes", "slices", "ends", "terms", "counts")}
                ids, sizes = cell["ids"].as_py(), np.array(cell["sizes"].as_py(), np.int64)
                slices = np.frombuffer(cell["slices"].as_buffer(), np.uint8).reshape(1 << cell["bits"].as_py(), -1)
                ends = np.append(0, np.frombuffer(cell["ends"].as_buffer(), np.int64))
                terms = np.frombuffer(cell["terms"].as_buffer(), np.uint64)
                counts = np.frombuffer(cell["counts"].as_buffer(), np.int64)
                m = 75 + 25 * sizes * q.n // q.total
                step = max(8, BOUNDS // max(1, len(q.terms)) // 8 * 8)
                for lo in range(0, len(ids), step):
                    at = slice(lo, min(lo + step, len(ids)))
                    bounds = _bounds(q, slices[:, lo // 8:(lo + step) // 8], cell["bits"].as_py(), sizes[at], m[at])
                    for i, (places, weights) in enumerate(q.items):
                        if len(places):
                            most = weights @ bounds[places]
                            score_best(i, lo, most, ids, ends, terms, counts, m)
        found = [(i, None if null else doc, -score) for i, rows in enumerate(best) for score, null, doc in sorted(rows)[:top]]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3,
                              names=["item", "doc_id", "score"])

    return run, "item long, doc_id long, score long"


def _document_frequencies(index: LexicalIndex, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted ``terms`` occurs: a lookup in every dictionary piece."""
    shared = index.spark.sparkContext.broadcast(terms)

    def run(batches):
        for batch in batches:
            total = np.zeros(len(shared.value), np.int64)
            for have, counts in zip(batch.column("terms"), batch.column("counts")):
                have = np.frombuffer(have.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(have, shared.value), len(have) - 1)
                total += np.frombuffer(counts.as_buffer(), np.int64)[at] * (have[at] == shared.value)
            place = np.flatnonzero(total)
            yield pa.record_batch([pa.array(place), pa.array(total[place])], names=["place", "df"])

    out = np.zeros(len(terms), np.int64)
    pieces_ = index.part("terms").select("terms", "counts").mapInArrow(run, "place long, df long")
    found = pieces_.groupBy("place").agg(F.sum("df").alias("df")).toArrow()
    out[found.column("place").to_numpy()] = found.column("df").to_numpy()
    return out


def _answer(index: LexicalIndex, n: int, total: int, items: list[tuple], top: int) -> DataFrame:
    """The best documents of one block of items: (item_id, rank, doc_id, score)."""
    terms = np.unique(np.concatenate([t for _, t, _ in items]))
    df = _document_frequencies(index, terms)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1)))
    # A term without weight adds nothing, one without documents cannot occur.
    use = (weights > 0) & (df > 0)
    place = np.cumsum(use) - 1
    asked = []
    for _, own, counts in items:
        at = np.searchsorted(terms, own)
        asked.append((place[at][use[at]], (weights[at] * counts)[use[at]]))
    spark = index.spark
    shared = spark.sparkContext.broadcast(_Queries(weights[use], terms[use], asked, n, total))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    columns = ("bits", "ids", "sizes", "slices", "ends", "terms", "counts")

    def search(needed, *kinds):
        rows = index.part(*kinds).select(*columns).mapInArrow(*_search(shared, needed, top))
        return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    needed = np.zeros(len(items), np.int64)
    early = search(needed, "seed").where(F.col("rank") == top).toArrow()  # one number per item
    needed[early.column("item").to_numpy()] = early.column("score").to_numpy()
    found = search(needed, "seed", "block")
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _, _) in enumerate(items)], "item long, item_id long")
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(index: LexicalIndex, items: DataFrame, top: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` best documents of each row of ``items`` with a score above 0.

    Equal scores rank by ascending id, null ids last. A row of ``items`` without terms, or whose terms occur nowhere, gives no
    rows; rows that share an item_id are answered one by one. Items come to the driver in blocks of at most ``ITEMS``
    items and about ``TERMS`` terms, each answered by its own pass over the index. Without documents there are no rows.
    """
    spark = index.spark
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    n, total = index.part("seed", "block").agg(
        F.sum(F.size("ids").cast("long")), F.sum(size)).first() if _written(index) else (None, None)
    path = os.path.join(scratch_root(spark), f"answers-{uuid.uuid4().hex}")
    answers, waiting, heard = 0, [], 0

    def answer():
        with _batches_of(spark, BLOCK_ROWS):
            _answer(index, n, total, waiting, top).write.mode("append").parquet(path)

    if n:
        asked = narrow(items, id=items[id_col].cast("long"), text=items[text_col].cast("string"))
        asked = materialize(asked.mapInArrow(_read_items, "id long, terms binary, counts binary"), "items")
        for row in asked.toLocalIterator():
            own = np.frombuffer(row.terms, np.uint64)
            if waiting and (len(waiting) >= ITEMS or heard + len(own) > TERMS):
                answer()
                answers, waiting, heard = answers + 1, [], 0
            waiting.append((row.id, own, np.frombuffer(row.counts, np.int64)))
            heard += len(own)
        if waiting:
            answer()
            answers += 1
    return spark.read.schema(ANSWER).parquet(path) if answers else spark.createDataFrame([], ANSWER)


def _written(index: LexicalIndex) -> bool:
    """Whether the index holds any rows: an empty partitioned table has no folders to read."""
    path = index.spark._jvm.org.apache.hadoop.fs.Path(index.path)
    files = path.getFileSystem(index.spark._jsc.hadoopConfiguration())
    return any(s.isDirectory() for s in files.listStatus(path))


@register("op11_lexical_search", r"""
    with d as (
      select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[0-9a-z\x{80}-\x{10FFFF}]+') as terms
      from documents),
    s as (select count(*)::hugeint as n_docs, sum(len(terms))::hugeint as total from d where len(terms) > 0),
    t as (
      select doc_id, 75 + (25 * len(terms) * n_docs) // total as m, unnest(terms) as term
      from d, s where len(terms) > 0),
    tf as (select doc_id, m, term, count(*)::hugeint as tf from t group by all),
    w as (
      select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)))::hugeint as w
      from tf, s group by term, n_docs),
    q as (
      select item_id, unnest(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[0-9a-z\x{80}-\x{10FFFF}]+')) as term
      from benchmark),
    r as (
      select item_id, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
      from (select item_id, term, count(*) as qf from q group by all) join w using (term) join tf using (term)
      group by item_id, doc_id)
    select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score
    from r where score > 0
    qualify rank <= 20""")
def op11_lexical_search(spark, sf_dir):
    """The 20 best documents for every benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
