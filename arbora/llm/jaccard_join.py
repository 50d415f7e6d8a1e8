"""Exact self-join of documents by the Jaccard similarity of their word shingles, through count-vector R-trees.

Shingles are hashed into groups; the counts per group are a point, and the overlap of two sets is at most the sum of
the smaller counts, coordinate by coordinate. With |A ∩ B| ≥ t/(1+t)·(|A|+|B|) as the condition for similarity t,
points and, for the nodes of an R-tree, upper corners whose bound is lower are left out without looking at sets.

To keep every tree small, the index is split by shared shingles: in one fixed order of all shingles, two similar
sets share one among the first |A| − ⌈t·|A|⌉ + 1 of either. The order puts frequent shingles last, as told by a
counter array of bounded size over all shingles; any order is right, this one keeps the parts of the index small.
Links are found in two rounds. In the first each document of a part is tried with the part's smallest id, which joins
dense families by a few links each. In the second the R-tree of every part that still holds several components gives
all pairs across components that the bound admits. Whatever either round proposes is checked with finer counts (as many
groups as shingles), then with the whole sets, so only true links count and none that could join two components is
missed.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import narrow, pieces, register, table, text_bytes
from arbora.llm.components import connected_components
from arbora.llm.shingles import mix, shingle_sets
from arbora.operators.skew import hot_split_join
from arbora.session import SMALL_TABLE_BYTES, materialize

GROUPS = 64
LEAF = 64
FAN_OUT = 8
#: Shingles per counter of the frequency sketch, as long as it has no more than 2 ** SKETCH_BITS counters (64 MB).
PER_COUNTER = 8
SKETCH_BITS = 24
#: Members of a frequent shingle's part that one task of the first round takes.
CHUNK = 20_000
SLICE = 1 << 16
#: Tasks whose counters meet in the first of two rounds.
MEET_TASKS = 64
#: A side of a join is sent to all tasks up to so many narrow rows.
FEW = 1_000_000


def admitted(overlap, total, num: int, den: int):
    """overlap / (total − overlap) ≥ num / den, in integers."""
    return overlap * (num + den) >= num * total


def _each_set(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for piece in pieces(batch):
            yield piece.column("id"), shingle_sets(*text_bytes(piece.column("text")), width)


def _keys(width: int):
    def run(batches):
        for ids, sets in _each_set(batches, width):
            marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            pair = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(pair[:, 0].copy()),
                                   pa.array(pair[:, 1].copy())], names=["id", "n", "k1", "k2"])

    return run, "id long, n long, k1 long, k2 long"


def _sketch(width: int, bits: int):
    def run(batches):
        total = np.zeros(1 << bits, np.int32)
        for _, sets in _each_set(batches, width):
            if sets:
                np.add.at(total, (np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), 1)
        for at in range(0, len(total), SLICE):
            part = total[at : at + SLICE]
            if part.any():
                yield _slice_batch(at, 0, part)

    return run, SLICES


SLICES = "at long, salt long, counts binary"


def _slice_batch(at: int, salt: int, part: np.ndarray) -> pa.RecordBatch:
    """One slice of counters in the narrowest integers that hold them; their width is the first byte."""
    narrow_part = part.astype(np.min_scalar_type(int(part.max())))
    packed = bytes([narrow_part.itemsize]) + zlib.compress(narrow_part.tobytes(), 1)
    return pa.record_batch([pa.array([at], pa.int64()), pa.array([salt], pa.int64()), pa.array([packed], pa.binary())],
                           names=["at", "salt", "counts"])


def _slice(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed[1:]), f"<u{packed[0]}")


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices of each (at, salt) of a sorted partition, holding one slice at a time."""
    key, total = None, np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.to_pylist():
            part = _slice(row["counts"])
            if (row["at"], row["salt"]) != key:
                if key:
                    yield _slice_batch(*key, total)
                key, total = (row["at"], row["salt"]), np.zeros(len(part), np.int64)
            total += part
    if key:
        yield _slice_batch(*key, total)


def shingle_frequencies(docs: DataFrame, width: int, bits: int) -> list[tuple[int, bytes]]:
    """Counters, 2 ** bits of them, over the shingles of all (id, text): how often each counter's shingles occur, as packed
    slices (place, counts); one that is left out holds zeros.

    A task's counters leave it in about a byte per shingle or less, whatever their number. They meet by slice in two
    rounds; a task adds one slice after the other and holds only their sum.
    """
    run, kind = _sketch(width, bits)
    # Neighbouring tasks meet first, so what the first round leaves is one slice of each MEET_TASKS.
    salt = F.floor(F.spark_partition_id() / F.lit(MEET_TASKS)).cast("long")
    parts = docs.mapInArrow(run, kind).withColumn("salt", salt)
    for salted in (F.col("salt"), F.lit(0).cast("long")):
        parts = parts.withColumn("salt", salted).repartition("at", "salt").sortWithinPartitions("at", "salt")
        parts = parts.mapInArrow(_sum_slices, SLICES)
    return [(row["at"], bytes(row["counts"])) for row in parts.select("at", "counts").collect()]


def shares_of_parts(slices: list[tuple[int, bytes]], bits: int, chunk: int) -> np.ndarray:
    """Per counter: 0 if its shingles are rare, else into how many shares of ``chunk`` to deal a part.

    Slices are unpacked one at a time, as the driver has little room: it holds the shares alone, two bytes a counter.
    """
    total, top = 0, 0
    for _, packed in slices:
        part = _slice(packed)
        total, top = total + int(part.sum(dtype=np.int64)), max(top, int(part.max()))
    mean = total / (1 << bits)
    # Counters far above what rare shingles that share one by chance would give.
    usual = mean + 6 * math.sqrt(mean) + 32
    shares = np.zeros(1 << bits, np.uint16 if top <= chunk * 0xFFFF else np.int64)
    for at, packed in slices:
        part = _slice(packed).astype(np.int64)
        shares[at : at + len(part)] = np.where(part > usual, -(-part // chunk), 0)
    return shares


def _prefixes(width: int, num: int, den: int, bits: int, frequent, chunk: int):
    """Rows (token, salt, id, n): the shingles by which a set can meet a similar one, and a share of their part."""

    def run(batches):
        parts = frequent.value  # per counter: 0 if its shingles are rare, else into how many shares to deal a part
        shift = np.uint64(64 - bits)
        for ids, sets in _each_set(batches, width):
            tokens, salts, owner, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
            for s in sets:
                n = len(s)
                often = parts[(s >> shift).astype(np.int64)] > 0
                s = np.concatenate([s[~often], s[often]])[: n - -(-num * n // den) + 1 if n else 0]
                share = np.maximum(parts[(s >> shift).astype(np.int64)].astype(np.int64), 1)
                tokens.append(s)
                # Another share for each shingle, so that shares of one part meet in those of others.
                own = np.uint64(n * 0x9E3779B1 + (int(s[0]) & 0xFFFFFFFF if n else 0))
                salts.append(np.where(share > 1, 1 + (mix(s ^ own) % np.uint64(1 << 31)).astype(np.int64) % share, 0))
                owner.append(len(s))
                size.append(n)
            yield pa.record_batch(
                [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(salts)),
                 ids.take(pa.array(np.repeat(np.arange(len(sets)), owner))), pa.array(np.repeat(size, owner).astype(np.int64))],
                names=["token", "salt", "id", "n"])

    return run, "token long, salt long, id long, n long"


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a sorted partition, many at a time, with the row offsets between them."""
    rest, wait = None, 0

    def cut(t: pa.Table, last: bool):
        changed = np.zeros(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            changed[1:] |= v[1:] != v[:-1]
        starts = np.concatenate([[0], np.flatnonzero(changed)])
        end = t.num_rows if last else int(starts[-1])
        return (t.slice(0, end), np.append(starts[starts < end], end)), t.slice(end)

    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        rest = new if rest is None else pa.concat_tables([rest, new])
        if rest.num_rows < wait:  # a group of many batches is looked at again only when it has doubled
            continue
        done, rest = cut(rest.combine_chunks(), False)
        wait = 2 * rest.num_rows
        if done[0].num_rows:
            yield done
    if rest is not None and rest.num_rows:
        yield cut(rest.combine_chunks(), True)[0]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of parts with two documents or more, each with the smallest id of its share of the part and that one's size.

    Rows of a dealt part (salt > 0) all stay, as the others may be in other shares.
    """
    for t, offsets in _groups(batches, ["token", "salt"]):
        size = np.diff(offsets)
        ids, n = t.column("id").to_numpy(), t.column("n").to_numpy()
        low = np.minimum.reduceat(ids, offsets[:-1])
        high = np.maximum.reduceat(ids, offsets[:-1])
        group = np.repeat(np.arange(len(size)), size)
        at = np.flatnonzero(ids == low[group])
        n_low = np.zeros(len(size), np.int64)
        n_low[group[at]] = n[at]
        keep = np.flatnonzero((low < high)[group] | (t.column("salt").to_numpy() > 0))
        for a in range(0, len(keep), 50_000):
            k = keep[a : a + 50_000]
            yield pa.record_batch([pa.array(t.column("token").to_numpy()[k]), pa.array(ids[k]), pa.array(n[k]),
                                   pa.array(low[group[k]]), pa.array(n_low[group[k]])],
                                  names=["token", "id", "n", "low", "n_low"])


class CountTree:
    """A packed R-tree over count vectors: points sorted by set size, LEAF per leaf, FAN_OUT nodes per parent.

    A node keeps the largest count per group, the range of sizes and, if all its points have one, their component.
    """

    def __init__(self, points: np.ndarray, n: np.ndarray, comp: np.ndarray):
        self.points, self.n, self.comp = points, n, comp
        starts = np.arange(0, len(n), LEAF)
        low = np.minimum.reduceat(comp, starts)
        high = np.maximum.reduceat(comp, starts)
        level = (np.maximum.reduceat(points, starts), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts),
                 low, high)
        self.levels = [level]
        while len(level[1]) > 1:
            starts = np.arange(0, len(level[1]), FAN_OUT)
            level = tuple(f.reduceat(x, starts) for f, x in zip(
                (np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), level))
            self.levels.append(level)

    def _may_hold(self, depth: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        top, small, large, low, high = self.levels[depth]
        ok = (den * large[i] >= num * small[j]) & (den * large[j] >= num * small[i])
        ok &= ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j, where = i[ok], j[ok], np.flatnonzero(ok)
        bound = np.minimum(top[i], top[j]).sum(1, dtype=np.int64)
        ok[where] = admitted(bound, small[i] + small[j], num, den)
        return ok

    def pairs(self, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of points of different components that the bound admits, by descending the tree with itself."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            depth, i, j = stack.pop()
            if len(i) > 4096:
                half = len(i) // 2
                stack += [(depth, i[:half], j[:half]), (depth, i[half:], j[half:])]
                continue
            ok = self._may_hold(depth, i, j, num, den)
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            if depth:
                below = len(self.levels[depth - 1][1])
                a = (i[:, None, None] * FAN_OUT + np.arange(FAN_OUT)[None, :, None])
                b = (j[:, None, None] * FAN_OUT + np.arange(FAN_OUT)[None, None, :])
                a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
                inside = (a < below) & (b < below) & (a <= b)
                stack.append((depth - 1, a[inside], b[inside]))
            else:
                for x, y in zip(i, j):
                    yield self._leaves(int(x) * LEAF, int(y) * LEAF, num, den)

    def _leaves(self, x: int, y: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.arange(x, min(x + LEAF, len(self.n))), np.arange(y, min(y + LEAF, len(self.n)))
        i, j = (m.ravel() for m in np.meshgrid(a, b, indexing="ij"))
        return self.survivors(*((i[i < j], j[i < j]) if x == y else (i, j)), num, den)

    def survivors(self, i: np.ndarray, j: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        n, comp = self.n, self.comp
        ok = (comp[i] != comp[j]) & (den * n[i] >= num * n[j]) & (den * n[j] >= num * n[i])
        i, j = i[ok], j[ok]
        ok = admitted(np.minimum(self.points[i], self.points[j]).sum(1, dtype=np.int64), n[i] + n[j], num, den)
        return i[ok], j[ok]


def _scan_pairs(num: int, den: int):
    """Pairs (a, b) of ids that the bound admits, of parts that are one leaf each; many parts at a time."""

    def run(batches):
        for t, offsets in _groups(batches, ["token"]):
            ids, n, comp = (t.column(c).to_numpy() for c in ("id", "n", "comp"))
            leaf = CountTree(read_points(t.column("point").to_pylist(), GROUPS), n, comp)
            end = np.repeat(offsets[1:], np.diff(offsets))
            rows, found = np.arange(len(ids)), []
            for step in range(1, LEAF):
                rows = rows[rows + step < end[rows]]
                if not len(rows):
                    break
                found.append(leaf.survivors(rows, rows + step, num, den))
            yield _pair_batch(ids, found)

    return run, "a long, b long"


def _tree_pairs(num: int, den: int):
    """Pairs (a, b) of ids that the R-trees of larger parts admit.

    Rows come by size; a tree holds the documents of one class of sizes and those smaller ones that may be similar
    to them, with as many groups as suit their size.
    """

    def run(batches):
        for t, offsets in _groups(batches, ["token"]):
            for start, stop in zip(offsets[:-1], offsets[1:]):
                ids, n, comp = (t.column(c).to_numpy()[start:stop] for c in ("id", "n", "comp"))
                points = unpack_points(t.column("point").slice(start, stop - start).to_pylist())
                home = 0
                while home < len(n):
                    last = int(np.searchsorted(n, 2 * n[home]))
                    first = int(np.searchsorted(n, -(-num * int(n[home]) // den)))
                    groups = min(map(len, points[first:last]))
                    tree = CountTree(read_points(points[first:last], groups), n[first:last], comp[first:last])
                    found, held = [], 0
                    for i, j in tree.pairs(num, den):
                        own = j >= home - first  # pairs below were found in the class before
                        found.append((i[own], j[own]))
                        held += int(own.sum())
                        if held > 200_000:
                            yield _pair_batch(ids[first:last], found)
                            found, held = [], 0
                    yield _pair_batch(ids[first:last], found)
                    home = last

    return run, "a long, b long"


def _pair_batch(ids, found):
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    pair = np.unique(np.sort(np.stack([ids[i], ids[j]], 1), axis=1), axis=0)
    return pa.record_batch([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])


def count_point(s: np.ndarray, groups: int) -> bytes:
    """Counts per group in one byte each; 255 stands for any number from 255 on."""
    return np.minimum(np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups), 255).astype(
        np.uint8).tobytes()


def read_points(points: list[bytes], groups: int) -> np.ndarray:
    """Points folded to ``groups`` (a power of two, as all lengths are). What 255 stands for is no bound for others."""
    out = np.empty((len(points), groups), np.uint32)
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(points):
        by_length.setdefault(len(p), []).append(i)
    for length, rows in by_length.items():
        v = np.frombuffer(b"".join(points[i] for i in rows), np.uint8).reshape(len(rows), length // groups, groups)
        v = np.where(v == 255, np.uint32(1 << 24), v.astype(np.uint32))
        out[rows] = v.sum(1, dtype=np.uint32)
    return out


def pack_point(point: bytes) -> bytes:
    """A long point in about two bits a count: pairs carry the points of both ends through a shuffle."""
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(point) + coder.flush()


def unpack_points(packed: list[bytes]) -> list[bytes]:
    return [zlib.decompress(p, -15) for p in packed]


def groups_for(n: int, per_group: float) -> int:
    return 1 << max(3, math.ceil(math.log2(max(1.0, n / per_group))))


def _points(width: int, per_group: float | None):
    """Count vectors: GROUPS groups, or (packed) a power of two for about ``per_group`` shingles in each."""

    def run(batches):
        for ids, sets in _each_set(batches, width):
            rows = [pack_point(count_point(s, groups_for(len(s), per_group))) if per_group else count_point(s, GROUPS)
                    for s in sets]
            yield pa.record_batch([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(rows, pa.binary())],
                                  names=["id", "n", "point"])

    return run, "id long, n long, point binary"


def _bound(num: int, den: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y, total in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist(),
                                   batch.column("total").to_pylist()):
                x, y = unpack_points([x, y])
                both = read_points([x, y], min(len(x), len(y)))
                ok.append(admitted(int(both.min(0).sum(dtype=np.int64)), total, num, den))
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run, "a long, b long"


def _whole(width: int):
    def run(batches):
        for ids, sets in _each_set(batches, width):
            yield pa.record_batch([ids, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                                  names=["id", "set"])

    return run, "id long, set array<long>"


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (written, without repeats): by broadcast if it is small enough."""
    small = ids.count() * 16 <= SMALL_TABLE_BYTES // 2
    return docs.join(F.broadcast(ids) if small else ids, "id", "left_semi")


def _few(side: DataFrame, width: int = 1) -> DataFrame:
    """``side`` marked for broadcast if its rows, ``width`` times a narrow row, are few; else as it is."""
    return F.broadcast(side) if side.count() * width <= FEW else side


def _verify(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Those of the distinct, written ``pairs`` (a, b) whose whole sets are similar enough."""

    def ends(p):
        return materialize(p.select(F.col("a").alias("id")).union(p.select("b")).distinct(), "ids")

    def side(p, t, end, **columns):
        own = t.select(F.col("id").alias(end), *[F.col(c).alias(f"{new}{end}") for new, c in columns.items()])
        return own.join(F.broadcast(p) if small else p, end)

    def two(p, t, **columns):
        """Both ends' columns of ``t``: the narrow pairs go to its rows, then the two halves meet."""
        return side(p, t, "a", **columns).join(side(p, t, "b", **columns), ["a", "b"])

    small = pairs.count() <= FEW
    fine = materialize(_only(docs, ends(pairs)).mapInArrow(*_points(width, 1.0)), "fine")
    likely = two(pairs, fine, v="point", n="n").select("a", "b", "va", "vb", (F.col("na") + F.col("nb")).alias("total"))
    likely = materialize(likely.mapInArrow(*_bound(num, den)), "likely")
    whole = materialize(_only(docs, ends(likely)).mapInArrow(*_whole(width)), "sets")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    total = (F.size("sa") + F.size("sb")).cast("long")
    return two(likely, whole, s="set").where(admitted(common, total, num, den)).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                       num: int = 75, den: int = 100, sketch_bits: int = SKETCH_BITS,
                       chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, itself included).

    Two documents link if den·|A ∩ B| ≥ num·|A ∪ B| for their sets of distinct ``width``-word shingles (A-Z in lower
    case); a text with fewer words is one shingle, a null or wordless text has none and links with nothing. An id
    that repeats has a row for each of its rows; null ids take part in no link and have component null. An empty table
    gives no rows; other columns are not read. ``sketch_bits`` and ``chunk`` only change the work.
    """
    spark = docs.sparkSession
    docs = narrow(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string"))
    keyed = materialize(docs.mapInArrow(*_keys(width)), "keys")
    # Equal sets are linked (and one of them stands for all).
    same = materialize(keyed.where("n > 0 and id is not null").groupBy("k1", "k2", "n").agg(
        F.min("id").alias("rep"), F.count("*").alias("copies")), "same")
    members = keyed.where("n > 0 and id is not null")
    rep_of = hot_split_join(members, same.drop("n"), ["k1", "k2"], "copies", members.count(), same.count()).select(
        "id", "n", "rep")
    reps = materialize(same.select(F.col("rep").alias("id")).distinct(), "reps")
    docs = docs.where("id is not null")

    shingles = keyed.agg(F.sum("n")).first()[0] or 0
    bits = min(sketch_bits, max(8, math.ceil(math.log2(1 + shingles / PER_COUNTER))))
    shared_counts = spark.sparkContext.broadcast(shares_of_parts(shingle_frequencies(docs, width, bits), bits, chunk))
    tokens = _only(docs, reps).mapInArrow(*_prefixes(width, num, den, bits, shared_counts, chunk))
    parts = tokens.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "id")
    meets = materialize(parts.mapInArrow(
        _meet, "token long, id long, n long, low long, n_low long"), "meets")
    close = (F.col("n") * den >= F.col("n_low") * num) & (F.col("n_low") * den >= F.col("n") * num)
    first = materialize(meets.where(close & (F.col("id") != F.col("low"))).select(
        F.col("low").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    links = materialize(_verify(docs, first, width, num, den), "links")

    labels = materialize(connected_components(links), "labels")
    rows = meets.select("token", "id", "n").join(_few(labels), meets["id"] == labels["node"], "left").select(
        "token", "id", "n", F.coalesce("component", "id").alias("comp"))
    rows = materialize(rows, "labelled")
    # Members of one component need not be compared again; parts with a single one are done.
    mixed = rows.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"),
                                      F.count("*").alias("rows")).where("low < high").select("token", "rows")
    open_rows = materialize(rows.join(_few(materialize(mixed, "mixed")), "token"), "open")

    def searched(part, per_group, search):
        points = materialize(_only(docs, materialize(part.select("id").distinct(), "ids")).mapInArrow(
            *_points(width, per_group)), "points")
        part = part.drop("rows").join(_few(points.drop("n"), 8), "id").repartition("token")
        return part.sortWithinPartitions("token", "n", "id").mapInArrow(*search(num, den))

    second = searched(open_rows.where(F.col("rows") <= LEAF), None, _scan_pairs).unionByName(
        searched(open_rows.where(F.col("rows") > LEAF), 2.0, _tree_pairs))
    second = second.distinct().join(first, ["a", "b"], "left_anti")
    links = links.unionByName(_verify(docs, materialize(second, "pairs"), width, num, den))

    labels = connected_components(links)
    found = rep_of.join(labels, rep_of["rep"] == labels["node"], "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    alone = keyed.where("n = 0 or id is null").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return found.unionByName(alone)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that link, directly or not, with one of smaller id. Columns as they were.

    Rows without id link with nothing and stay; rows that share an id stay or go together.
    """
    gone = jaccard_components(docs, id_col, **options).where("component_id <> doc_id").select(
        F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")


@register("op3_jaccard_join")
def op3_jaccard_join(spark, sf_dir):
    """The near-duplicate component of every document."""
    return jaccard_components(table(spark, sf_dir, "documents"))
