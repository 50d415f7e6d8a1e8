"""The trie of conversation prefixes, read off the sorted conversations.

A conversation is the sequence of the 128-bit digests of its turns. Sorted (range partitions, external sort), all that
start with one prefix lie side by side: a node of the trie is an interval. With the length of the common prefix (LCP) of
each conversation and the one before it, a position i starts exactly the nodes of depth LCP[i] + 1 … length[i], and a
node of depth d reaches as far as LCPs of at least d follow. Each partition holds its LCPs in a sparse table of range
minima, and each candidate (position, depth) searches its own right end, and its parent's left end, by halving steps.
Everything else is a range sum or a range minimum over the interval: members, leaves, the smallest id, the bytes that are
stored once instead of several times, and the ends, which stand first.

Intervals that go on beyond a partition are few: only prefixes of the conversation at its edge can. Each partition also
reports, for every depth that is open at its left edge, what it adds to that prefix; the partition where an open prefix
starts is found by the same halving search over one minimum per partition. Their sums give the nodes that cross edges.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora.llm.common import narrow, register, table
from arbora.operators.skew import hot_split_join
from arbora.session import materialize

#: Conversations that one partition of the sorted table should hold at most.
PER_PARTITION = 100_000
#: Hex digits of a turn's digest.
DIGEST = 32
GROUP = 5
HEAD = 9
_SORTED = "part int, pos long, conv_id long, turns int, lcp int, sizes binary, first binary, last binary"
_NODES = ("kind string, part int, depth int, conv_id long, n long, children long, leaves long, saved long, ends string, "
          "up_part int, up_conv long, head_bytes long")


def _turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """id, at (0, 1, … in its conversation), digest, size: one row per turn; the texts stay behind."""
    rows = narrow(conversations, id=conversations[conv].cast("long"), turn=conversations[turn].cast("long"),
                  role=F.coalesce(conversations[role].cast("string"), F.lit("")),
                  text=F.coalesce(conversations[text].cast("string"), F.lit(""))).where("id is not null")
    size = F.octet_length("text").cast("long")
    # The length of the role keeps ("a", "bc") and ("ab", "c") apart.
    whole = F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text")
    rows = rows.select("id", "turn", F.md5(whole).alias("digest"), size.alias("size"))
    order = Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "digest", "size")
    return materialize(rows.select("id", (F.row_number().over(order) - 1).alias("at"), "digest", "size"), "turns")


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """conv_id, seq (digests of all turns, joined), sizes (bytes of each text): every conversation with the first turns
    of the conversation its group starts with."""
    turns = _turns(conversations, conv, turn, role, text)
    ids = turns.where("at = 0").select("id")
    head = F.crc32(F.col("id").cast("string")) % HEAD
    heads = ids.select("id", (F.col("id") - F.col("id") % GROUP).alias("base"), head.alias("head"))
    own = turns.where(F.col("at") >= head)
    # At most HEAD turns of a conversation, for at most 2 * GROUP - 1 ids of one group.
    first = turns.where(F.col("at") < HEAD).select(F.col("id").alias("base"), "at", "digest", "size")
    given = heads.join(first, "base").where("at < head").select("id", "at", "digest", "size")
    return own.unionByName(given).groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("at", "digest", "size"))).alias("turns")).join(ids, "id", "right").select(
        F.col("id").alias("conv_id"),
        F.coalesce(F.array_join("turns.digest", ""), F.lit("")).alias("seq"),
        F.coalesce(F.col("turns.size"), F.array().cast("array<long>")).alias("sizes"))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many digests two sequences share at their start."""
    n = min(len(a), len(b)) // DIGEST * DIGEST
    differ = np.flatnonzero(a[:n] != b[:n])
    return (int(differ[0]) if len(differ) else n) // DIGEST


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and LCPs inside one sorted partition; whole sequences only of its first and last row."""
    part = TaskContext.get().partitionId()
    pos, before, last = 0, None, None
    for batch in batches:
        rows = []
        for conv_id, seq, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "sizes"))):
            now = np.frombuffer(seq.encode(), np.uint8)
            lcp = -1 if before is None else _common(before, now)
            rows.append((part, pos, conv_id, len(sizes), lcp, np.array(sizes, np.int64).tobytes(),
                         now.tobytes() if pos == 0 else None, None))
            before, pos = now, pos + 1
        if rows:
            yield _rows(rows, _SORTED)
    if before is not None:
        # The last row again, for the edge only.
        yield _rows([(part, -1, 0, 0, 0, b"", None, before.tobytes())], _SORTED)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return pa.record_batch([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[f for f, _ in fields])


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """table[k][i] = min(values[i : i + 2^k])."""
    out = [values]
    while 2 << len(out) - 1 <= len(values):
        half = 1 << len(out) - 1
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


def reach_right(minima: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each candidate the last position r >= at with values[at + 1 … r] all >= depth."""
    end, n = at.copy(), len(minima[0])
    for k in range(len(minima) - 1, -1, -1):
        room = end + (1 << k) < n
        ok = np.zeros(len(end), bool)
        ok[room] = minima[k][end[room] + 1] >= depth[room]
        end[ok] += 1 << k
    return end


def reach_left(minima: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each candidate the first position l <= at with values[l + 1 … at] all >= depth."""
    begin = at.copy()
    for k in range(len(minima) - 1, -1, -1):
        room = begin - (1 << k) >= 0
        ok = np.zeros(len(begin), bool)
        ok[room] = minima[k][begin[room] - (1 << k) + 1] >= depth[room]
        begin[ok] -= 1 << k
    return begin


def range_min(minima: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """min(values[left … right]) of each range."""
    out = np.empty(len(left), minima[0].dtype)
    level = np.frexp((right - left + 1).astype(float))[1] - 1
    for k in np.unique(level):
        own = level == k
        out[own] = np.minimum(minima[k][left[own]], minima[k][right[own] - (1 << int(k)) + 1])
    return out


def _partition(part: int, rows: pa.Table, edge: dict, owner) -> Iterator[pa.RecordBatch]:
    """All nodes that start in one partition, and what it adds to each prefix that is open at its left edge.

    edge: ``left`` LCP with the row before the partition (-1 if none), ``right`` LCP of the next partition with its last.
    """
    conv = rows.column("conv_id").to_numpy()
    length = rows.column("turns").to_numpy().astype(np.int64)
    lcp = rows.column("lcp").to_numpy().astype(np.int64)
    lcp[0] = max(0, edge["left"])
    n = len(conv)
    sizes = np.frombuffer(b"".join(rows.column("sizes").to_pylist()), np.int64)
    # upto[offset[i] + k] = bytes of the first k turns of conversation i.
    total = np.append(0, np.cumsum(sizes))
    turn_at = np.append(0, np.cumsum(length))

    def bytes_of(i, k):
        return total[turn_at[i] + k] - total[turn_at[i]]

    minima, ids = sparse_table(lcp), sparse_table(conv)
    next_lcp = np.append(lcp[1:], edge["right"])
    leaf = np.append(0, np.cumsum(next_lcp < length))
    shared = bytes_of(np.arange(n), lcp)
    stored_once = np.append(0, np.cumsum(shared))
    ended = np.append(0, np.flatnonzero(np.append(length[1:] != length[:-1], True) | np.append(lcp[1:] < length[1:], True)) + 1)
    # Copies of a conversation stand in a row; run_end[i] = position after the last copy of i.
    run_end = ended[np.searchsorted(ended, np.arange(n), side="right")]

    def members(i, d, end):
        """Ids of the conversations of exactly d turns at the start of an interval."""
        stop = min(int(run_end[i]), end + 1) if length[i] == d else i
        return ",".join(map(str, conv[i:stop].tolist()))

    # Candidates: every position with each depth it starts, the root left out.
    new = np.maximum(length - lcp, 0)
    at = np.repeat(np.arange(n), new)
    depth = np.repeat(lcp, new) + 1 + np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new)
    end = reach_right(minima, at, depth)
    up = reach_left(minima, at, depth - 1)
    own_up = (lcp[up] < depth - 1) | (depth == 1)  # else the parent starts in an earlier partition
    crosses = (end == n - 1) & (edge["right"] >= depth)
    up_end = reach_right(minima, up, depth - 1)
    up_crosses = (up_end == n - 1) & (edge["right"] >= depth - 1)
    # A child of (up, d - 1): count them where the parent starts here.
    inner = own_up & (depth > 1)
    code = up * (int(depth.max(initial=0)) + 1) + depth - 1
    keys, n_kids = np.unique(code[inner], return_counts=True)
    own_code = at * (int(depth.max(initial=0)) + 1) + depth
    found = np.searchsorted(keys, own_code)
    found[found == len(keys)] = 0
    children = np.where(keys[found] == own_code, n_kids[found], 0) if len(keys) else np.zeros(len(at), np.int64)
    before = bytes_of(at, depth - 1)
    low = range_min(ids, at, end)
    saved = stored_once[end + 1] - stored_once[at + 1] - (end - at) * before
    leaves = leaf[end + 1] - leaf[at]
    up_conv = range_min(ids, up, up_end)
    settled = own_up & ~up_crosses & (depth > 1)
    # Where a parent that is open at an edge starts: here, or at the last partition before with a smaller minimum.
    up_part = np.where(settled | (depth == 1), -1, np.where(own_up, part, owner(part, depth - 1)))
    out = []
    for i in range(len(at)):
        out.append(("open" if crosses[i] else "node", part, int(depth[i]), int(low[i]), int(end[i] - at[i] + 1), int(children[i]),
                    int(leaves[i]), int(saved[i]), members(int(at[i]), int(depth[i]), int(end[i])), int(up_part[i]),
                    int(up_conv[i]) if settled[i] else None, int(before[i])))
        if len(out) >= 20_000:
            yield _rows(out, _NODES)
            out = []
    # The prefixes that come in open, the root (depth 0) among them.
    open_depths = np.arange(0, max(0, edge["left"]) + 1)
    zero = np.zeros(len(open_depths), np.int64)
    stops = reach_right(minima, zero, open_depths)
    homes = owner(part, open_depths)
    kids = np.bincount(depth[~own_up] - 1, minlength=len(open_depths)) if (~own_up).any() else zero
    tops = int((depth == 1).sum())
    for d, stop in zip(open_depths.tolist(), stops.tolist()):
        ends = members(0, d, stop) if d else ",".join(map(str, conv[: int(np.searchsorted(length > 0, True))].tolist()))
        # Every member here, also the first, shares the prefix with a member before: its bytes are stored there.
        head = int(bytes_of(0, max(0, d - 1)))
        out.append(("part", part, d, int(conv[: stop + 1].min()), stop + 1, tops if d == 0 else int(kids[d]),
                    int(leaf[stop + 1]), int(stored_once[stop + 1]) - (stop + 1) * head, ends, -1 if d == 0 else int(homes[d]), None, head))
    yield _rows(out, _NODES)


def _nodes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        order, least = known["parts"], known["minima"]
        table_ = sparse_table(least)

        def owner(part, depths):
            """The partition where the prefix of each depth that is open at the left edge of ``part`` starts."""
            here = int(np.searchsorted(order, part))
            depths = np.asarray(depths, np.int64)
            if not here:
                return np.full(len(depths), -1)
            # The last partition before with a minimum below the depth: values[l + 1 … here - 1] are all at least that.
            return order[reach_left(table_, np.full(len(depths), here - 1), depths)]

        def done(part, held):
            rows = pa.Table.from_batches(held)
            here = int(np.searchsorted(order, part))
            edge = {"left": int(known["left"][here]),
                    "right": int(known["left"][here + 1]) if here + 1 < len(order) else -1}
            yield from _partition(part, rows, edge, owner)

        part, held = None, []
        for batch in batches:
            parts = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if parts[a] != part:
                    if held:
                        yield from done(part, held)
                    part, held = int(parts[a]), []
                held.append(batch.slice(a, b - a))
        if held:
            yield from done(part, held)

    return run


def _edges(ordered: DataFrame) -> dict[str, np.ndarray]:
    """Per partition: its number, the LCP of its first row with the row before, and its smallest LCP with that."""
    inner = ordered.where("pos >= 0").groupBy("part").agg(F.min(F.when(F.col("pos") > 0, F.col("lcp"))).alias("least"))
    ends = ordered.where("first is not null or last is not null").groupBy("part").agg(
        F.first("first", True).alias("first"), F.first("last", True).alias("last"))
    # One row per partition of the sorted table.
    numbered = ends.join(inner, "part").withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part")))
    numbered = materialize(numbered, "edges")
    pairs = numbered.select("part", "rank", "least", "first").join(
        numbered.select((F.col("rank") + 1).alias("rank"), F.col("last").alias("before")), "rank", "left")

    def compare(batches):
        for batch in batches:
            out = []
            for part, least, first, before in zip(*(batch.column(c).to_pylist() for c in ("part", "least", "first", "before"))):
                left = -1 if before is None else _common(np.frombuffer(before, np.uint8), np.frombuffer(first, np.uint8))
                out.append((part, left, left if least is None else min(least, left)))
            yield _rows(out, "part int, left int, low int")

    rows = pairs.select("part", "least", "first", "before").mapInArrow(compare, "part int, left int, low int").toArrow()
    rows = rows.sort_by("part")
    return {"parts": rows.column("part").to_numpy().astype(np.int64), "left": rows.column("left").to_numpy().astype(np.int64),
            "minima": rows.column("low").to_numpy().astype(np.int64)}


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the joined ids of one node, piece by piece: a batch of pieces is all that is held."""
    key, state, started = None, None, False
    out = []
    for batch in batches:
        for home, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("home", "depth", "ends"))):
            if (home, depth) != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state, started = (home, depth), hashlib.sha256(), False
            if ends:
                state.update(("," + ends if started else ends).encode())
                started = True
        if len(out) > 10_000:
            yield _rows(out, "home int, depth int, sha string")
            out = []
    if key is not None:
        out.append((*key, state.hexdigest()))
    yield _rows(out, "home int, depth int, sha string")


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Turns are ordered by turn, null first; turns of one conversation with equal numbers by their contents. A null role or
    text is empty. Rows without conversation id are left out; a row equal to another is one more turn. Without
    conversations there are no nodes, not even the root. Other columns are not read. The digests of one conversation (not
    its texts) must fit in a row.
    """
    spark = conversations.sparkSession
    convs = materialize(rebuilt(conversations, conv, turn, role, text), "rebuilt")
    n = convs.count()
    wide = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PER_PARTITION))
    # The splitters differ between attempts of one plan, so what depends on them is written.
    ordered = materialize(convs.repartitionByRange(wide, "seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(
        _number, _SORTED), "sorted")
    shared = spark.sparkContext.broadcast(_edges(ordered))
    rows = ordered.where("pos >= 0").select("part", "pos", "conv_id", "turns", "lcp", "sizes")
    found = rows.repartition(wide, "part").sortWithinPartitions("part", "pos").mapInArrow(_nodes(shared), _NODES)
    found = materialize(found, "nodes")
    columns = ["depth", "conv_id", "n", "children", "leaves", "saved", "up_part", "up_conv"]

    # Open prefixes, by (partition they start in, depth): at most one of each.
    home = F.when(F.col("kind") == "open", F.col("part")).otherwise(F.col("up_part"))
    several = found.where("kind <> 'node'").withColumn("home", home)
    sums = several.groupBy("home", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")],
        F.max(F.when(F.col("kind") == "open", F.col("up_part"))).alias("up_part"),
        F.max(F.when(F.col("kind") == "open", F.col("up_conv"))).alias("up_conv"))
    pieces = several.select("home", "depth", "part", "ends").repartition("home", "depth").sortWithinPartitions(
        "home", "depth", "part").mapInArrow(_hash_pieces, "home int, depth int, sha string")
    crossing = materialize(sums.join(pieces, ["home", "depth"]), "crossing")
    inside = found.where("kind = 'node'").select(*columns, F.sha2("ends", 256).alias("sha"))
    whole = crossing.where("depth > 0").select(*columns, "sha")
    nodes = inside.unionByName(whole)

    root = crossing.where("depth = 0")
    top = root.select("conv_id").first()
    known = nodes.where("depth = 1 or up_part < 0").withColumn(
        "parent_conv_id", F.when(F.col("depth") == 1, F.lit(top and top[0]).cast("long")).otherwise(F.col("up_conv")))
    keyed = crossing.where("depth > 0").select(F.col("home").alias("up_part"), (F.col("depth") + 1).alias("depth"),
                                               F.col("conv_id").alias("parent_conv_id"), F.col("children").alias("_rows"))
    waiting = nodes.where("depth > 1 and up_part >= 0")
    named = hot_split_join(waiting, materialize(keyed, "parents"), ["up_part", "depth"], "_rows", found.count()).drop("_rows")
    root = root.select(*columns, "sha", F.lit(None).cast("long").alias("parent_conv_id"))
    every = known.unionByName(named).unionByName(root)
    return every.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"),
                        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                        F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"))


@register("op12_prefix_trie", """
    with t as (
      select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as nr,
             coalesce(role, '') as role, coalesce(text, '') as text
      from conversations where conv_id is not null),
    c as (
      select distinct conv_id as c, conv_id - conv_id % 5 as base,
             xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''),
                   lambda s: [ascii(s), -1, -1, -1, -1, -1, -1, -1, -1]))),
                 lambda a, x: case when x >= 0 then xor(a, x::bigint)
                                   else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295) % 9 as h
      from t),
    r as (
      select c, nr, role, text from c join t on t.conv_id = base and nr < h
      union all select c, nr, role, text from c join t on t.conv_id = c and nr >= h),
    s as (
      select c, row_number() over w as d, strlen(text) as bytes,
             string_agg(md5(strlen(role) || ':' || role || ':' || text), '') over w as k
      from r window w as (partition by c order by nr)),
    p as (
      select c, d::bigint as d, bytes, k from s
      union all select c, 0, 0, '' from c),
    l as (select c, max(d) as turns from p group by c),
    n as (
      select d, k, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * max(bytes) as own,
             coalesce(string_agg(case when turns = d then c::varchar end, ',' order by c), '') as ends
      from p join l using (c) group by d, k),
    x as (select n.*, case when d = 0 then null else substr(k, 1, (32 * (d - 1))::bigint) end as up from n),
    kids as (select d - 1 as d, up as k, count(*) as n_children from x where d > 0 group by all),
    y as (select x.*, coalesce(n_children, 0) as n_children from x left join kids using (d, k)),
    under as (select distinct a.d, a.k, b.d as bd, b.k as bk from p a join p b on a.c = b.c and a.d <= b.d),
    below as (
      select u.d, u.k, count(*) filter (y.n_children = 0) as n_leaves, sum(y.own)::bigint as saved_tokens
      from under u join y on y.d = u.bd and y.k = u.bk group by u.d, u.k)
    select y.conv_id, y.d as depth, z.conv_id as parent_conv_id, y.n_convs, y.n_children, n_leaves, saved_tokens,
           sha256(y.ends) as ends_sha256
    from y join below using (d, k) left join y z on z.d = y.d - 1 and z.k = y.up""")
def op12_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))
