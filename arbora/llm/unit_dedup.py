"""Removing repeated lines, sentences of lines, or paragraphs.

Units are normalised (A-Z in lower case, runs of white space as one space, none at the ends) and hashed to 128 bits.
Digests are grouped over all documents with partial aggregation; the occurrence with the smallest (document id, position) stays.
Only digests that occur twice or more meet their rows again, the hot ones of them by broadcast.

A repeated unit goes only as part of a run: repeated units that follow one another, blank ones between them left aside,
which hold a least number of words together. Lines of prose are also cut at sentence ends, so that a passage is found
whatever stands before and after it on its first and last line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import narrow, register, table
from arbora.operators.skew import hot_split_join
from arbora.session import materialize

#: Words of a run of repeated units that goes. Shorter ones, such as a set phrase or a greeting, stay.
RUN_WORDS = 20
_BREAK = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n[\s]*")}
_LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


#: A sentence with the blanks after it: up to a mark that white space follows, or to the end of the line.
SENTENCE = r"[^.!?\n]*(?:[.!?]+[^.!?\x20\x09-\x0D][^.!?\n]*)*[.!?]*[\x20\x09\x0B-\x0D]*\n?"
_SENTENCE = re.compile(SENTENCE)
#: What stands between units and is put back between those that stay.
JOINTS = {"line": "\n", "paragraph": "\n\n", "sentence": ""}


def cut(text: str, unit: str = "line") -> list[tuple[int, int]]:
    """(start, end) of every unit in code points. Sentences hold what separates them, so they fill the whole text."""
    if unit == "sentence":
        return [m.span() for m in _SENTENCE.finditer(text) if m.end() > m.start()]
    out, at = [], 0
    for gap in _BREAK[unit].finditer(text):
        out.append((at, gap.start()))
        at = gap.end()
    return [*out, (at, len(text))]


def normalise(unit: str) -> str:
    return _SPACE.sub(" ", unit.translate(_LOWER)).strip(" ")


def words_of(unit: str) -> int:
    plain = normalise(unit)
    return plain.count(" ") + bool(plain)


def _digests(unit: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, place, start, end, k1, k2 = ([] for _ in range(6))
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for p, (a, b) in enumerate(cut(text or "", unit)):
                    plain = normalise(text[a:b]) if b > a else ""
                    if not plain:
                        continue
                    mark = hashlib.blake2b(plain.encode(), digest_size=16).digest()
                    for column, v in zip((ids, place, start, end, k1, k2), (
                            i, p, a, b, int.from_bytes(mark[:8], "little", signed=True),
                            int.from_bytes(mark[8:], "little", signed=True))):
                        column.append(v)
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (ids, place, start, end, k1, k2)],
                                  names=["id", "place", "start", "end", "k1", "k2"])

    return run, "id long, place long, start long, end long, k1 long, k2 long"


def repeated_units(docs: DataFrame, unit: str = "sentence", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every unit that is not its first occurrence: doc_id, place (0, 1, …), start, end (code points), first_id,
    first_place, copies."""
    rows = narrow(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string")).where("id is not null")
    units = materialize(rows.mapInArrow(*_digests(unit)), "units")
    firsts = materialize(units.groupBy("k1", "k2").agg(
        F.count("*").alias("copies"), F.min(F.struct("id", "place")).alias("first")).where("copies > 1"), "firsts")
    met = hot_split_join(units, firsts, ["k1", "k2"], "copies", units.count(), firsts.count())
    return met.where("id <> first.id or place <> first.place").select(
        F.col("id").alias("doc_id"), "place", "start", "end", F.col("first.id").alias("first_id"),
        F.col("first.place").alias("first_place"), "copies")


def long_runs(text: str, repeated: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of the repeated units that lie in runs of at least ``least`` words; ``repeated`` by start."""
    out, run, n = [], [], 0
    for a, b in repeated:
        if run and text[run[-1][1] : a].strip(" \t\n\x0b\x0c\r"):  # something else stands between
            out += run if n >= least else []
            run, n = [], 0
        run.append((a, b, words_of(text[a:b])))
        n += run[-1][2]
    return out + run if n >= least else out


def drop_repeated_units(docs: DataFrame, unit: str = "sentence", run_words: int = RUN_WORDS, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_removed, removed_words, text (what stays), removed_spans.

    ``unit`` is "sentence" (lines cut at sentence ends), "line" or "paragraph"; ``run_words`` = 1 removes every repeated unit.
    ``removed_spans`` is "start:end" of every removed unit in the original text, comma-joined. Blank units stay. A null
    text counts as empty. Rows that share an id rank alike and are cut alike; rows without id stay whole. An empty table gives
    no rows; other columns are not read.
    """
    gone = repeated_units(docs, unit, id_col, text_col).groupBy("doc_id").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    rows = narrow(docs, id=docs[id_col].cast("long"), text=F.coalesce(docs[text_col].cast("string"), F.lit("")))
    met = rows.join(gone, rows["id"] == gone["doc_id"], "left").select(
        "id", "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "ends"))):
                # Too few characters for so many words: nothing to look at.
                some = starts and sum(ends) - sum(starts) >= 2 * run_words - 1
                drop = long_runs(text, list(zip(starts, ends)), run_words) if some else []
                out.append((len(drop), sum(n for _, _, n in drop), _without(text, drop, unit) if drop else text,
                            ",".join(f"{a}:{b}" for a, b, _ in drop)))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[
                "doc_id", "n_removed", "removed_words", "text", "removed_spans"])

    return met.mapInArrow(run, "doc_id long, n_removed long, removed_words long, text string, removed_spans string")


def _without(text: str, drop: list[tuple[int, int, int]], unit: str) -> str:
    gone = {(a, b) for a, b, _ in drop}
    return JOINTS[unit].join(text[a:b] for a, b in cut(text, unit) if (a, b) not in gone)


@register("op6_unit_dedup", rf"""
    with c as (select doc_id, regexp_extract_all(coalesce(text, ''), '{SENTENCE}') as units from documents),
    l as (
      select doc_id, unnest(units) as unit, generate_subscripts(units, 1) as place from c),
    p as (
      select *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[ 	-
]+', ' ', 'g'), ' ') as plain,
             coalesce(sum(length(unit)) over (partition by doc_id order by place
                      rows between unbounded preceding and 1 preceding), 0) as start
      from l where unit <> ''),
    w as (
      select *, case when plain = '' then 0 else length(plain) - length(replace(plain, ' ', '')) + 1 end as words,
             plain <> '' and row_number() over (partition by plain order by doc_id, place) > 1 as again
      from p),
    r as (
      select *, count(*) filter (words > 0 and not again) over (partition by doc_id order by place) as run from w),
    g as (
      select *, again and sum(words) filter (again) over (partition by doc_id, run) >= {RUN_WORDS} as gone from r)
    select d.doc_id, count(*) filter (gone) as n_removed, coalesce(sum(words) filter (gone), 0)::bigint as removed_words,
           coalesce(string_agg(unit, '' order by place) filter (not gone), '') as text,
           coalesce(string_agg(start::bigint || ':' || (start + length(unit))::bigint, ',' order by place)
                    filter (gone), '') as removed_spans
    from documents d left join g using (doc_id) group by d.doc_id""")
def op6_unit_dedup(spark, sf_dir):
    """Every document without the runs of sentences that stand earlier in it or in a document of smaller id."""
    return drop_repeated_units(table(spark, sf_dir, "documents"))
