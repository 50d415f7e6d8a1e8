"""A stored concept tree that grows by micro-batches: a base and what each batch changed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.operators.restructure import overlay
from arbora.operators.tree import ConceptTree, TreeParams
from arbora.operators.tree_build import append_rows, build_tree, refresh_depth
from arbora.sources.storage import load_embeddings, load_tree, save_tree

COMPACT_SHARE = 0.25  # changes of this share of the base's nodes are folded into a new base
COMPACT_BATCHES = 16  # and so are changes of so many batches


class TreeStore:
    """Versions of a tree under one folder.

    ``base_<batch>`` holds whole tables; ``delta_<batch>`` the node rows that a batch changed or added (or that are gone) and its
    members. ``log`` names finished versions: a version counts once its row is there, and a batch interrupted before that is
    simply done again. Reading lays the changes over the base, the latest row of a node first. What a batch writes follows the
    batch, until the changes are worth a new base.
    """

    def __init__(self, spark: SparkSession, root: str, params: TreeParams = TreeParams()):
        self.spark, self.root, self.params = spark, root, params

    def log(self) -> list:
        """One row per finished batch, in order: batch, kind, n_nodes, reshaped."""
        found = load_embeddings(self.spark, os.path.join(self.root, "log"))
        return [] if found is None else sorted(found.collect(), key=lambda r: r["batch"])

    def latest(self) -> int | None:
        log = self.log()
        return log[-1]["batch"] if log else None

    def _path(self, kind: str, batch: int) -> str:
        return os.path.join(self.root, f"{kind}_{batch}")

    def load(self) -> ConceptTree:
        log = self.log()
        if not log:
            raise ValueError(f"no tree stored in {self.root}")
        start = max(i for i, r in enumerate(log) if r["kind"] == "base")
        base = load_tree(self.spark, self._path("base", log[start]["batch"]))
        later = log[start + 1:]
        if not later:
            return base
        nodes, members = [], base.members
        for r in later:
            path = self._path("delta", r["batch"])
            nodes.append(self.spark.read.parquet(f"{path}/nodes").withColumn("_batch", F.lit(r["batch"])))
            members = members.unionByName(self.spark.read.parquet(f"{path}/members"))
        changes = nodes[0]
        for more in nodes[1:]:
            changes = changes.unionByName(more)
        columns = [c for c in changes.columns if c != "_batch"]
        if len(nodes) > 1:
            last = F.max_by(F.struct(*columns), "_batch")
            changes = changes.groupBy("node_id").agg(last.alias("row")).select("row.*")
        whole = overlay(base.nodes, changes.select(*columns))
        if any(r["reshaped"] for r in later):
            whole = refresh_depth(whole, write=False)
        depth = int(whole.agg(F.max("depth")).first()[0])
        return ConceptTree(whole, members, depth, base.params, str(later[-1]["batch"]))

    def append(self, rows: DataFrame, batch: int) -> None:
        """rows(doc_id, vec); a batch already in the log is skipped."""
        log = self.log()
        if log and batch <= log[-1]["batch"] or rows.isEmpty():
            return
        if not log:
            self._save_base(build_tree(rows, self.params, version=str(batch)), batch)
            return
        tree = append_rows(self.load(), rows, str(batch))
        path, n = self._path("delta", batch), tree.delta.nodes.count()
        start = max(i for i, r in enumerate(log) if r["kind"] == "base")
        waiting = log[start + 1:]
        if n + sum(r["n_nodes"] for r in waiting) > COMPACT_SHARE * log[start]["n_nodes"] or len(waiting) >= COMPACT_BATCHES:
            self._save_base(tree, batch)
            return
        tree.delta.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        tree.delta.members.write.mode("overwrite").parquet(f"{path}/members")
        self._done(batch, "delta", n, tree.delta.reshaped)

    def _save_base(self, tree: ConceptTree, batch: int) -> None:
        save_tree(tree, self._path("base", batch))
        self._done(batch, "base", tree.nodes.count(), False)

    def _done(self, batch: int, kind: str, n_nodes: int, reshaped: bool) -> None:
        row = self.spark.createDataFrame([(batch, kind, n_nodes, reshaped)], "batch bigint, kind string, n_nodes bigint, reshaped boolean")
        row.coalesce(1).write.mode("append").parquet(os.path.join(self.root, "log"))

    def follow(self, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Append every micro-batch of stream(doc_id, vec); ``once`` stops when all waiting input is in."""
        writer = stream.writeStream.foreachBatch(lambda df, i: self.append(df, i)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
