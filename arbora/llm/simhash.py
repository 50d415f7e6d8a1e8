"""Near duplicates by SimHash fingerprints, found through the anchor points of a covering code.

A fingerprint has 64 bits. Two that differ in at most t of them differ in at most t // 2 bits of one 32-bit half. In
each half the words of a linear code are the anchors. Its covering radius is R, so every value has an anchor, its home,
at a distance r <= R; a value y within t // 2 of x then lies within r + t // 2 of x's home. So every fingerprint goes
to its home and, as a replica, to all anchors that near; each home is compared with the replicas at its anchor. Of two
linked fingerprints the one that lies nearer to its home finds the other, so a replica need not go farther than its
own r + t // 2, which is at most R + t // 2.

Equal fingerprints collapse before they are copied. A task that compares an anchor keeps the links as a forest and
skips what is linked already, so no list of all pairs within a group is ever made. Crowded anchors are cut into a grid
of home shares and replica shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import SPACES, narrow, pieces, register, table
from arbora.llm.components import connected_components
from arbora.operators.skew import hot_split_join
from arbora.session import materialize, spread

SEED = 42
WIDTH = 4
DISTANCE = 4
#: Rows of one anchor that one task compares; more are cut into a grid.
SHARE = 1 << 15
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)

# Parity checks of the anchor code, one column per bit of a half: the perfect [23,12] code of radius 3 (its
# columns are the powers of x modulo x^11+x^9+x^7+x^6+x^5+x+1), the perfect [7,4] code of radius 1 (its columns are
# 1 .. 7), and two bits without checks. Together: 2^18 anchors of radius 4.
GOLAY = 0b101011100011
CHECKS = 14
RADIUS = 4


def _columns() -> list[int]:
    out, power = [], 1
    for _ in range(23):
        out.append(power)
        power <<= 1
        if power >> 11:
            power ^= GOLAY
    return out + [k << 11 for k in range(1, 8)] + [0, 0]


@lru_cache(1)
def _bytewise() -> np.ndarray:
    """syndrome[k, v]: the checks of byte k of a half when it has value v."""
    columns = _columns()
    out = np.zeros((4, 256), np.int64)
    for k in range(4):
        for bit in range(8):
            out[k] ^= np.where(np.arange(256) >> bit & 1, columns[8 * k + bit], 0)
    return out


def syndromes(halves: np.ndarray) -> np.ndarray:
    parts = _bytewise()
    return parts[0][halves & 255] ^ parts[1][halves >> 8 & 255] ^ parts[2][halves >> 16 & 255] ^ parts[3][halves >> 24 & 255]


@lru_cache(2)
def anchor_steps(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome, what to add to a value to get to its anchors, the nearest first: (start, count, steps).

    Steps of syndrome s are steps[start[s] : start[s] + count[s]]: all of weight up to that of the lightest + ``reach``.
    """
    steps, weights = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for weight in range(1, RADIUS + reach + 1):
        last = steps[-1]  # ascending, so those below a bit stand in front
        steps.append(np.concatenate([last[: np.searchsorted(last, 1 << bit)] | 1 << bit for bit in range(32)]))
        weights.append(np.full(len(steps[-1]), weight))
    step, weight = np.concatenate(steps), np.concatenate(weights)
    own = syndromes(step)
    order = np.lexsort((step, weight, own))
    step, weight, own = step[order], weight[order], own[order]
    start = np.searchsorted(own, np.arange(1 << CHECKS))
    keep = weight <= weight[start[own]] + reach
    step, own = step[keep], own[keep]
    start = np.searchsorted(own, np.arange(1 << CHECKS))
    return start, np.diff(np.append(start, len(own))), step


def fingerprint_text(text: str | None, width: int = WIDTH) -> int:
    """The fingerprint of one text, as a plain loop (the reference for tests)."""
    words = (text or "").encode().translate(_LOWER).translate(bytes.maketrans(SPACES, b" " * len(SPACES))).split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes = [0] * 64
    for gram in grams:
        h = xxhash.xxh64_intdigest(gram, SEED)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def _hashes(text: str | None, width: int) -> list[int]:
    words = (text or "").encode().translate(_LOWER).translate(_BLANKS).split()
    if not words:
        return []
    plain = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(plain, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(plain[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


_BLANKS = bytes.maketrans(SPACES, b" " * len(SPACES))


def fingerprints(texts: list[str | None], width: int = WIDTH) -> np.ndarray:
    """Fingerprints of many texts: votes are counted in byte lanes, eight bits of a hash at a time."""
    out = np.zeros(len(texts), np.uint64)
    hashes, rows, sizes = [], [], []
    for i, text in enumerate(texts):
        own = _hashes(text, width)
        if own:
            hashes.append(np.array(own, np.uint64))
            rows.append(i)
            sizes.append(len(own))
    if not rows:
        return out
    h, sizes = np.concatenate(hashes), np.array(sizes)
    ends = np.cumsum(sizes)
    # A byte lane holds at most 255 votes: every text is summed in runs of so many hashes.
    runs = -(-sizes // 255)
    first = np.repeat(np.cumsum(runs) - runs, runs)
    starts = np.repeat(ends - sizes, runs) + 255 * (np.arange(runs.sum()) - first)
    text_of_run = np.cumsum(runs) - runs
    found = np.zeros(len(rows), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat(h >> np.uint64(k) & _LANES, starts)
        votes = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), text_of_run, axis=0)
        for lane in range(8):
            bit = (2 * votes[:, lane] > sizes).astype(np.uint64)
            found |= bit << np.uint64(8 * lane + k)
    out[rows] = found
    return out


def _read(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                fp = fingerprints(batch.column("text").to_pylist(), width).view(np.int64)
                yield pa.record_batch([batch.column("id"), pa.array(fp)], names=["id", "fp"])

    return run, "id long, fp long"


def _replicas(reach: int):
    """Every fingerprint at its home and at all anchors near enough, for both halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, count, steps = anchor_steps(reach)
        for batch in batches:
            whole = batch.column("fp").to_numpy()
            for at in range(0, len(whole), 2048):
                fp = whole[at : at + 2048]
                for half in range(2):
                    value = fp.view(np.uint64) >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)
                    value = value.astype(np.int64)
                    s = syndromes(value)
                    n = count[s]
                    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    anchor = np.repeat(value, n) ^ steps[np.repeat(start[s], n) + offset]
                    yield pa.record_batch(
                        [pa.array(anchor | half << 32), pa.array(np.repeat(fp, n)), pa.array(offset == 0)],
                        names=["anchor", "fp", "home"])

    return run, "anchor long, fp long, home boolean"


def _forest(homes: np.ndarray, others: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between ``homes`` and ``others`` (bit patterns) that connect all of them that any link connects.

    A home is compared with everything not yet connected to it, so the work in a dense group stays small.
    """
    points = np.unique(np.concatenate([homes, others]))
    home, other = np.searchsorted(points, np.unique(homes)), np.searchsorted(points, np.unique(others))
    group, links = np.arange(len(points)), []
    for h in home:
        left = other[group[other] != group[h]]
        near = left[np.bitwise_count(points[left] ^ points[h]) <= distance]
        if len(near):
            groups, at = np.unique(group[near], return_index=True)
            links += [(points[h], points[near[i]]) for i in at]
            group[np.isin(group, groups)] = group[h]
    return links


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, homes = None, [], []

        def close():
            fp, home = np.concatenate(fps).view(np.uint64), np.concatenate(homes)
            if home.any() and len(fp) > 1:
                return _forest(fp[home], fp, distance)
            return []

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "i", "j")]
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            home = batch.column("home").to_numpy(zero_copy_only=False)
            change = np.zeros(len(fp), bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), len(fp)]
            links = []
            for a, b in zip(cuts, cuts[1:]):
                new = tuple(int(k[a]) for k in keys)
                if new != key:
                    if key is not None:
                        links += close()
                    key, fps, homes = new, [], []
                fps.append(fp[a:b])
                homes.append(home[a:b])
            yield _pairs(links)
        if key is not None:
            yield _pairs(close())

    return run, "a long, b long"


def _pairs(links: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE, share: int = SHARE) -> DataFrame:
    """a, b: links that connect all fingerprints (distinct longs in ``fp``) that differ in at most ``distance`` bits.

    A spanning forest per anchor, not all pairs: two linked fingerprints are always connected, maybe through others.
    ``share`` only changes the work.
    """
    copies = spread(prints, "fp").mapInArrow(*_replicas(distance // 2))
    crowd = materialize(copies.groupBy("anchor").agg(F.count("*").alias("rows")).where(F.col("rows") > share).select(
        "anchor", F.ceil(F.col("rows") / share).cast("int").alias("cuts")), "crowded")
    crowded = crowd.count()
    one = F.lit(0)
    if not crowded:
        dealt = copies.withColumns({"i": one, "j": one})
    else:
        # Every crowded anchor holds over ``share`` rows, so there are few of them.
        total = crowd.agg(F.sum("cuts")).first()[0]
        dealt = copies.join(F.broadcast(crowd) if total < 1 << 20 else crowd, "anchor", "left").withColumn(
            "cuts", F.coalesce("cuts", F.lit(1)))
        lot = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
        all_lots = F.sequence(F.lit(0), F.col("cuts") - 1)
        as_home = dealt.where("home").select("anchor", "fp", "home", lot.alias("i"), F.explode(all_lots).alias("j"))
        as_copy = dealt.select("anchor", "fp", F.lit(False).alias("home"), F.explode(all_lots).alias("i"), lot.alias("j"))
        dealt = as_home.unionByName(as_copy)
    dealt = dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return dealt.mapInArrow(*_compare(distance))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                       distance: int = DISTANCE, share: int = SHARE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Words are runs of anything but ASCII white space, A-Z in lower case; a fingerprint votes over the hashes of all
    ``width``-word shingles of the whole text, repeats included. Fewer words are one shingle; a null or wordless text has
    fingerprint zero, linked like any other. Two rows link if their fingerprints differ in at most ``distance`` bits.
    Rows that share an id link by their own fingerprints; a row without id links, too, but its id counts only if no
    row of its component has one (then component_id is null). An empty table gives no rows; other columns are not read.
    """
    rows = narrow(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string"))
    rows = materialize(rows.mapInArrow(*_read(width)), "prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("copies")), "distinct")
    links = materialize(fingerprint_links(prints.select("fp"), distance, share).distinct(), "links")
    labels = connected_components(links).select(F.col("node").alias("fp"), "component")
    labelled = materialize(prints.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "labelled")
    lowest = materialize(labelled.groupBy("component").agg(
        F.min("low").alias("component_id"), F.count("*").alias("members")), "lowest")
    n_prints, n_components = prints.count(), lowest.count()
    named = hot_split_join(labelled, lowest, ["component"], "members", n_prints, n_components).select(
        "fp", "component_id", "copies")
    met = hot_split_join(rows, named, ["fp"], "copies", rows.count(), n_prints)
    return met.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op13_simhash_anchors")
def op13_simhash_anchors(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    return simhash_components(table(spark, sf_dir, "documents"))
