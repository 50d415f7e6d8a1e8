import os
import random
import re
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")
sys.path.insert(0, os.path.dirname(__file__))

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
# Names that the operators use inside; a table may have them too.
EXTRA = ("id", "size", "src", "n", "rep", "hash", "prefix", "keep", "edge", "token", "sha", "places", "_id", "_copies",
         "_kept_id", "_gone", "_sha", "row", "_shared", "rank", "tag", "p", "bits", "k1", "component", "fine", "set", "name", "html")


def awkward_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties, one hot text."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base = prose(200)
    near = base.split()
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", ""), (4, "one", "en", "a"),
            (5, "One two  three\nfour", None, "b"), (6, "one two three four", "de", "b"),
            (7, prose(60_000), "en", "a"), (8, "x" * 300_000, "en", None), (9, " " * 100_000 + "end", "en", "z"),
            (10, prose(120) + "\n" + prose(30), "en", "é"), (10, None, "en", "é"), (11, "1234 5678 !!!", None, "b")]
    rows += [(20 + i, base, "en", "hot") for i in range(60)]
    rows += [(200 + i, " ".join(near[:i] + [f"new{i}"] + near[i + 1:]), "en", "hot") for i in range(30)]
    rows += [(300 + i, prose(80), "de" if i % 2 else "en", "c") for i in range(40)]
    rows += [(12, "same row twice in the table\nsame row twice in the table", "en", "a")] * 2
    rows += [(None, "a text without id", "en", "a")]
    return rows


def frame(spark, rows):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, awkward_rows()).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"select * from '{SMALL}/documents.parquet' order by doc_id").df()


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
