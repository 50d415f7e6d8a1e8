"""Quality by n-gram perplexity: a modified Kneser-Ney model per language, counted by Spark over all documents.

Units are the bytes of the text (A-Z in lower case, white space as one space, four zero bytes in front), so an n-gram
of up to five units is an integer and its context and suffix are shifts and masks of it. Tasks count their share and
Spark adds up; continuation counts, discounts, back-off weights and probabilities are joins and short windows
(a context has at most 256 continuations). Every n-gram counted keeps a probability of its own, however many there
are: the most frequent ones are broadcast as sorted 64-bit hashes up to a fixed number, and a document's n-grams beyond
them meet their probabilities in a join. What is broadcast is bounded, what is joined grows with the input.
Per language, scores far outside the middle half of all documents that pass the base rules are rejected, on
either side: very improbable text is noise, very probable text is repetition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import SPACES, narrow, pieces, register, table, text_bytes
from arbora.llm.shingles import _LOWER, _SPACE, mix
from arbora.session import materialize

ORDER = 5
#: Bits of a hash: of a billion n-grams one in 10 ** 10 lookups of another n-gram hits.
HASH_BITS = 64
#: N-grams that are broadcast, 12 bytes each, the frequent ones first; the others are joined.
HEAD = 8_000_000
#: N-grams of this order and longer that occur once give their whole count to the back-off and are not stored:
#: otherwise a text would be predicted from what it alone has said.
ONCE_FROM = 3
#: A band reaches so many times the width of the middle half beyond its quartiles.
REACH = 3.0
#: Scores are compared in steps of 1 / BINS bit per byte.
BINS = 1000
#: Distinct n-grams that a task holds before it compacts or passes them on.
HELD = 2_000_000


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code of the ORDER-gram that ends at each unit of each text, and the number of units of each text."""
    low = _LOWER[raw]
    blank = _SPACE[low]
    before = np.empty(len(low), bool)
    before[1:] = blank[:-1]
    before[offsets[:-1][offsets[:-1] < len(low)]] = True
    keep = ~(blank & before)
    low = np.where(blank, np.uint8(32), low)[keep]
    ends = np.concatenate([[0], np.cumsum(keep)])[offsets]
    count = np.diff(ends)
    pad = ORDER - 1
    place = np.arange(len(low)) + pad * (1 + np.repeat(np.arange(len(count)), count))
    wide = np.zeros(len(low) + pad * (len(count) + 1), np.uint64)
    wide[place] = low
    code = wide[place]
    for k in range(1, ORDER):
        code |= wide[place - k] << np.uint64(8 * k)
    return code, count


def _compact(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(first) else count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (lang, gram, n) of a task's texts."""
    number: dict = {}
    codes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

    def out(code, count):
        names = np.array([*number, None], object)
        for a in range(0, len(code), 100_000):
            c = code[a : a + 100_000]
            yield pa.record_batch([pa.array(names[(c >> np.uint64(8 * ORDER)).astype(np.int64)], pa.string()),
                                   pa.array((c & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)),
                                   pa.array(count[a : a + 100_000])], names=["lang", "gram", "n"])

    for batch in batches:
        for piece in pieces(batch):
            langs = [number.setdefault(x, len(number)) for x in piece.column("lang").to_pylist()]
            code, size = units(*text_bytes(piece.column("text")))
            code |= np.repeat(np.array(langs, np.uint64), size) << np.uint64(8 * ORDER)
            distinct, n = np.unique(code, return_counts=True)
            codes.append(distinct)
            counts.append(n.astype(np.int64))
            if sum(map(len, codes)) > HELD:
                code, n = _compact(codes, counts)
                if len(code) > HELD // 2:
                    yield from out(code, n)
                    code, n = code[:0], n[:0]
                codes, counts = [code], [n]
    yield from out(*_compact(codes, counts))


def lang_salt(lang: str | None) -> int:
    return int.from_bytes(hashlib.blake2b(repr(lang).encode(), digest_size=8).digest(), "little")


def cut_hash(salt: np.ndarray, gram: np.ndarray, bits: int) -> np.ndarray:
    return mix(mix(gram) + salt) >> np.uint64(64 - bits)


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            salts = {x: lang_salt(x) for x in set(batch.column("lang").to_pylist())}
            salt = np.array([salts[x] for x in batch.column("lang").to_pylist()], np.uint64)
            slot = cut_hash(salt, batch.column("gram").to_numpy().astype(np.uint64), bits)
            yield pa.record_batch([batch.column("k"), pa.array(slot.view(np.int64)), batch.column("v"),
                                   batch.column("n")], names=["k", "slot", "v", "n"])

    return run, "k int, slot long, v double, n double"


@dataclass
class Model:
    """Sorted hashes with natural logs: per order of the probability, per length of context of the back-off weight."""

    bits: int
    prob: dict[int, tuple[np.ndarray, np.ndarray]]
    back: dict[int, tuple[np.ndarray, np.ndarray]]

    def log_probs(self, code: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """ln p of the last unit of each ORDER-gram; one that was never seen backs off to shorter ones."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            gram = code[left] & np.uint64((1 << 8 * k) - 1)
            seen, value = _find(self.prob.get(k), cut_hash(salt[left], gram, self.bits))
            out[left[seen]] += value[seen]
            left, gram = left[~seen], gram[~seen]
            if not len(left):
                return out
            seen, value = _find(self.back.get(k), cut_hash(salt[left], gram >> np.uint64(8), self.bits))
            out[left] += np.where(seen, value, 0.0)
        out[left] -= np.log(256)
        return out


def _find(arrays, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if arrays is None or not len(arrays[0]):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(arrays[0], keys), len(arrays[0]) - 1)
    return arrays[0][at] == keys, arrays[1][at]


def _order_table(grams: DataFrame, k: int, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Probabilities (lang, gram, n, p) of order k and back-off weights (lang, gram = context, n, v)."""
    rows = grams.withColumn("ctx", F.shiftright("gram", 8))
    of = [F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.0))

    def discount(i):
        a, b = F.col(f"n{i}"), F.col(f"n{i + 1}")
        return F.when((a > 0) & (y > 0), F.greatest(F.lit(0.1), F.least(F.lit(i - 0.1), i - (i + 1) * y * b / a))
                      ).otherwise(F.lit(0.5)).alias(f"d{i}")

    # One row per language.
    discounts = grams.groupBy("lang").agg(*of).select(F.col("lang").alias("_lang"), *[discount(i) for i in (1, 2, 3)])
    rows = rows.join(F.broadcast(discounts), F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    d = F.when(F.col("n") == 1, F.lit(1.0) if k >= ONCE_FROM else F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    ctx = Window.partitionBy("lang", "ctx")  # at most 256 rows
    rows = rows.withColumn("d", d).withColumn("all", F.sum("n").over(ctx)).withColumn(
        "gamma", F.sum("d").over(ctx) / F.col("all"))
    if lower is None:
        below = F.lit(1 / 256)
    else:
        low = lower.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("p").alias("_p"))
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))
        rows = rows.join(low, F.col("lang").eqNullSafe(F.col("_lang")) & (suffix == F.col("_gram"))).drop("_lang", "_gram")
        below = F.col("_p")
    p = (F.col("n") - F.col("d")) / F.col("all") + F.col("gamma") * below
    probs = materialize(rows.select("lang", "gram", "n", "ctx", "all", "gamma", p.alias("p")), f"order{k}")
    back = probs.groupBy("lang", F.col("ctx").alias("gram")).agg(
        F.first("all").cast("double").alias("n"), F.log(F.first("gamma")).alias("v"))
    return probs.select("lang", "gram", "n", "p"), back


def fit_kneser_ney(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = HASH_BITS) -> Model:
    """Count all texts of ``docs`` and estimate one model per language (a null language is one of its own).

    The whole model goes to the driver, to score other texts than it was fitted on; judge_quality does without.
    """
    parts = []
    for k, lower, back in _orders(docs, text_col, lang_col):
        stored = lower.where("n > 1") if k >= ONCE_FROM else lower
        parts.append(stored.select("lang", "gram", F.lit(k).alias("k"), F.log("p").alias("v"), F.col("n").cast("double")))
        # A context that gives all its mass to the back-off is like one never seen.
        parts.append(back.where("v <> 0").select("lang", "gram", F.lit(-k).alias("k"), "v", F.col("n").cast("double")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    arrays = _gather(whole, bits)
    return Model(bits, {k: a for k, a in arrays.items() if k > 0}, {-k: a for k, a in arrays.items() if k < 0})


def _orders(docs: DataFrame, text_col: str, lang_col: str) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """k, probabilities and back-off weights, from order 1 up."""
    rows = narrow(docs, text=docs[text_col].cast("string"), lang=docs[lang_col].cast("string")).where("text is not null")
    grams = {ORDER: materialize(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        grams[k] = grams[k + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n"))
    lower = None
    for k in range(1, ORDER + 1):
        lower, back = _order_table(grams[k], k, lower)
        yield k, lower, back


def _gather(entries: DataFrame, bits: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Entries (lang, gram, k, v, n) as sorted hashes and values per k; n-grams that meet at few bits share their mean."""
    entries = entries.mapInArrow(*_slots(bits)).groupBy("k", "slot").agg(
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("v")).select(
        F.col("k").cast("byte"), "slot", F.col("v").cast("float")).toArrow()
    arrays = {}
    which, slot, value = (entries.column(c).to_numpy() for c in ("k", "slot", "v"))
    slot = slot.view(np.uint64)
    for k in np.unique(which):
        rows_k = np.flatnonzero(which == k)
        rows_k = rows_k[np.argsort(slot[rows_k])]
        arrays[int(k)] = slot[rows_k], value[rows_k].astype(np.float32)
    return arrays


def _rarest_in_head(probs: DataFrame, most: int) -> int:
    """The smallest count from which on at most ``most`` n-grams stand; 1 if all of them do."""
    # A few hundred rows: counts in steps of a sixteenth of their size.
    step = F.expr("n - n % greatest(1L, cast(pow(2, floor(log2(n)) - 4) as bigint))")
    above, least = 0, None
    for r in probs.groupBy(step.alias("step")).agg(F.count("*").alias("c"), F.max("n").alias("top")).orderBy(F.desc("step")).collect():
        above += r.c
        if above > most:
            return least or r.top + 1
        least = r.step
    return 1


_SYMBOLS = b"#*$%&|<>"


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    raw = text.encode()
    words = raw.split()
    blanks = len(raw) - len(raw.translate(None, SPACES))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    repeated = 0
    if len(words) >= 3:
        number: dict[bytes, int] = {}
        w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
        n = len(number)
        pair = np.unique(w[:-1] * n + w[1:], return_inverse=True)[1]
        _, inverse, count = np.unique(pair[:-1] * n + w[2:], return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        hit = np.zeros(len(w), bool)
        for k in range(3):
            hit[k : len(w) - 2 + k] |= twice
        repeated = int(hit.sum())
    return (len(words), len(text) - blanks, len(raw) - len(raw.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated)


SCORES = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
          " n_repeat_words long, n_units long, ln double, rest array<long>")


def _score(head, bits: int):
    """Base counts, the sum of ln p of the n-grams in ``head`` and the other n-grams, of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *[(n, pa.int64()) for n in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_units")], ("ln", pa.float64()), ("rest", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            for piece in pieces(batch):
                texts, langs = piece.column("text"), piece.column("lang")
                code, size = units(*text_bytes(texts))
                number: dict = {}
                lang = np.array([number.setdefault(x, len(number)) for x in langs.to_pylist()], np.uint64)
                # An n-gram stands in a piece many times; it is looked up once.
                distinct, place = np.unique(code | np.repeat(lang, size) << np.uint64(8 * ORDER), return_inverse=True)
                salt = np.array([lang_salt(x) for x in number], np.uint64)[(distinct >> np.uint64(8 * ORDER)).astype(np.int64)]
                hit, value = _find(known, cut_hash(salt, distinct & np.uint64((1 << 8 * ORDER) - 1), bits))
                seen, value = hit[place], value[place]
                doc = np.repeat(np.arange(len(size)), size)
                sums = np.bincount(doc[seen], value[seen], len(size))
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[~seen], minlength=len(size)))])
                rest = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(code[~seen].view(np.int64)))
                base = np.array([base_counts(t or "") for t in texts.to_pylist()], np.int64).reshape(-1, 5)
                yield pa.record_batch([piece.column("id"), langs, *[pa.array(base[:, i].copy()) for i in range(5)],
                                       pa.array(size.astype(np.int64)), pa.array(sums), rest], schema=schema)

    return run, SCORES


def _bits_per_byte(docs: DataFrame, id_col: str, text_col: str, lang_col: str, bits: int, head: int) -> DataFrame:
    """Base counts and bits per byte of every document under the model of all of them.

    Each of their n-grams was counted, and one seen once has as its probability what its back-off gives, so the table of
    the highest order holds all that is looked up.
    """
    for _, probs, _ in _orders(docs, text_col, lang_col):
        pass
    least = _rarest_in_head(probs, head)
    frequent = probs.where(F.col("n") >= least).select(
        "lang", "gram", F.lit(ORDER).alias("k"), F.log("p").alias("v"), F.col("n").cast("double"))
    # At most ``head`` entries.
    shared = docs.sparkSession.sparkContext.broadcast(_gather(frequent, bits).get(ORDER))
    rows = narrow(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string"),
                  lang=docs[lang_col].cast("string"))
    scores = rows.mapInArrow(*_score(shared, bits))
    if least > 1:
        scores = materialize(scores.withColumn("_row", F.monotonically_increasing_id()), "heads")
        # An n-gram outside the head has fewer than ``least`` places, so no key is hot.
        rest = scores.select("_row", "lang", F.explode("rest").alias("gram"))
        tail = probs.where(F.col("n") < least).select(
            F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.log("p").alias("v"))
        found = rest.join(tail, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("gram") == F.col("_gram")))
        sums = found.groupBy("_row").agg(F.sum("v").alias("more"))
        scores = scores.drop("rest").join(sums, "_row", "left").withColumn(
            "ln", F.col("ln") + F.coalesce("more", F.lit(0.0))).drop("_row", "more")
    size = F.greatest("n_units", F.lit(1))
    return scores.withColumn("bits", -F.col("ln") / F.log(F.lit(2.0)) / size).drop("ln", "rest")


def perplexity_bands(scores: DataFrame, reach: float = REACH) -> DataFrame:
    """_lang, low, high in bits per byte, from all scores that passed the base rules, in steps of 1 / BINS bit."""
    bins = scores.where("not base_failed").groupBy("lang", F.floor(F.col("bits") * BINS).alias("bin")).agg(
        F.count("*").alias("n"))
    # A language has a few thousand bins at most: a byte costs a bounded number of bits.
    up = Window.partitionBy("lang").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))

    def quartile(q):
        return F.min(F.when(F.col("upto") >= F.col("all") * q, F.col("bin"))) / float(BINS)

    ends = bins.groupBy("lang").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    width = F.greatest(F.col("q3") - F.col("q1"), F.lit(0.1)) * reach
    return ends.select(F.col("lang").alias("_lang"), (F.col("q1") - width).alias("low"),
                       (F.col("q3") + width + 1.0 / BINS).alias("high"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  bits: int = HASH_BITS, reach: float = REACH, head: int = HEAD) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, perplexity (per byte), low and high (the band
    of its language).

    A null or wordless text has no words, fails the base rules and has perplexity 1. A null language is a language.
    Repeated rows count as often as they occur; an empty table gives no rows; other columns are not read.
    """
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    scores = materialize(_bits_per_byte(docs, id_col, text_col, lang_col, bits, head).withColumn("base_failed", failed), "scores")
    bands = perplexity_bands(scores, reach)
    # One row per language.
    judged = scores.join(F.broadcast(bands), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    inside = (F.col("bits") >= F.col("low")) & (F.col("bits") <= F.col("high"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), "low").alias("low"),
        F.pow(F.lit(2.0), "high").alias("high"))


@register("op1_quality")
def op1_quality(spark, sf_dir):
    """Base counts and the perplexity verdict of every document."""
    return judge_quality(table(spark, sf_dir, "documents"))
