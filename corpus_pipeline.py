"""From raw documents to token counts, one stage per operator of ``arbora.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
documents of the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from arbora.llm.bpe import public_bpe
from arbora.llm.common import table
from arbora.llm.exact_dedup import drop_exact_duplicates
from arbora.llm.jaccard_join import keep_one_of_each
from arbora.llm.language_id import fit_language_model, keep_recognised
from arbora.llm.mixing import repeat_documents
from arbora.session import materialize


def identify_language(spark, docs, sf_dir):
    """Documents in a language that the labelled ones among them teach; the rest go."""
    return keep_recognised(docs, fit_language_model(docs))


def exact_dedup(spark, docs, sf_dir):
    """One row of each group of equal texts: that with the smallest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each component of similar ones: that with the smallest id."""
    return keep_one_of_each(docs)


def mix(spark, docs, sf_dir):
    """Every document as often as the mix of sources takes it."""
    return repeat_documents(docs)


def encode(spark, docs, sf_dir):
    """Token counts and digests of every row that is left."""
    return public_bpe(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

# Learned scores and random rounding have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
