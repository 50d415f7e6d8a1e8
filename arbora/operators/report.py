"""Result files in, comparison tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "--"
METRICS = ("recall", "mrr", "ndcg")

# The layout of a result file and of its name.
BLOCK_PATTERN = r"--- Metrics for (.+) ---"
ROW_PATTERN = r"(?m)^\s*\|\s*@\d+\s*\|[^\n]*"
ROW_FIELDS = r"@(\d+)\s*\|\s*([^|\s]+)\s*\|\s*([^|\s]+)\s*\|\s*([^|\s]+)"
LATENCY_PATTERN = r"Avg Latency:\s*([\d.]+)\s*ms"
TOTAL_PATTERN = r"total time\s*([\d.]+)\s*seconds"
MODEL_PATTERN = r"benchmark_([^_]+)_"
CORPUS_PATTERN = r"_c(\d+)"


def read_metrics_text(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, model, corpus_size, method, avg_latency_ms, total_s, k, recall, mrr, ndcg); one row per table line."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.input_file_name().alias("file"))
    return parse_metrics_text(raw)


def parse_metrics_text(raw: DataFrame) -> DataFrame:
    """raw(file, value) with one result file per row."""
    number = lambda pattern: F.nullif(F.regexp_extract("block", pattern, 1), F.lit("")).cast("double")
    model = F.regexp_extract("file", MODEL_PATTERN, 1)
    blocks = raw.select(
        "file", F.when(model == "", "UnknownModel").otherwise(model).alias("model"),
        F.nullif(F.regexp_extract("file", CORPUS_PATTERN, 1), F.lit("")).cast("bigint").alias("corpus_size"),
        F.explode(F.split(F.trim(F.col("value"), F.lit("\n ")), "\n\n")).alias("block"))
    named = blocks.withColumn("method", F.trim(F.regexp_extract("block", BLOCK_PATTERN, 1))).where("method <> ''")
    lines = named.select(
        "file", "model", "corpus_size", "method", number(LATENCY_PATTERN).alias("avg_latency_ms"),
        number(TOTAL_PATTERN).alias("total_s"),
        F.explode(F.regexp_extract_all("block", F.lit(ROW_PATTERN), 0)).alias("line"))
    field = lambda i, t: F.regexp_extract("line", ROW_FIELDS, i).cast(t)
    return lines.select("file", "model", "corpus_size", "method", "avg_latency_ms", "total_s", field(1, "int").alias("k"),
                        field(2, "double").alias("recall"), field(3, "double").alias("mrr"), field(4, "double").alias("ndcg"))


def _long(metrics: DataFrame, k: int, selected: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value")) for m in selected])
    return metrics.where(F.col("k") == k).withColumn("p", F.explode(pairs)).select("*", "p.metric", "p.value")


def metrics_pivot(metrics: DataFrame, k: int, models: list[str], selected: tuple[str, ...] = METRICS) -> DataFrame:
    """method x (model, metric) at one cut-off; missing cells are "--"."""
    columns = [f"{m}|{s}" for m in models for s in selected]
    long = _long(metrics, k, selected).withColumn("col", F.concat_ws("|", "model", "metric"))
    return long.groupBy("method").pivot("col", columns).agg(F.first("value")).na.fill(MISSING, columns)


def metrics_by_corpus(metrics: DataFrame, k: int, models: list[str], sizes: list[int],
                      selected: tuple[str, ...] = METRICS) -> DataFrame:
    """method x (corpus size, metric): the first of ``models`` that has the cell."""
    columns = [f"{c}|{s}" for c in sizes for s in selected]
    order = F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model"))
    long = _long(metrics, k, selected).where(F.col("model").isin(models)).withColumn(
        "col", F.concat_ws("|", F.col("corpus_size").cast("string"), "metric"))
    return long.groupBy("method").pivot("col", columns).agg(F.min_by("value", order)).na.fill(MISSING, columns)


def scale_table(metrics: DataFrame, k: int, model: str, sizes: list[int], selected: tuple[str, ...] = METRICS,
                skip: tuple[int, ...] = (1000, 7500)) -> DataFrame:
    """One model over corpus sizes, without the sizes to skip (the defaults are fixed values)."""
    kept = [s for s in sizes if s not in skip]
    return metrics_by_corpus(metrics.where(F.col("model") == model), k, [model], kept, selected)


def runtime_table(metrics: DataFrame, methods: list[str], sizes: list[int]) -> DataFrame:
    """method x corpus size: average latency, two decimals; the later file wins."""
    names = [str(s) for s in sizes]
    one = metrics.where(F.col("method").isin(methods)).groupBy(
        "method", F.col("corpus_size").cast("string").alias("size")).agg(F.max_by("avg_latency_ms", "file").alias("latency"))
    shown = F.format_string("%.2f", F.first("latency"))
    table = one.where("latency is not null").groupBy("method").pivot("size", names).agg(shown)
    return table.na.fill(MISSING, names)
