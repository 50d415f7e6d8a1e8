"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are cut at boundaries where the splitting pattern ends a match whatever stands on either side, so the
encoding of the parts joined is the encoding of the whole and no call works on more than a bounded piece of
ordinary text. Decoding returns raw bytes: a single token need not be valid UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from arbora.llm.common import narrow, register, table

#: Texts beyond this many characters are cut.
PART = 20_000
# A match never holds a letter or digit followed by white space, and what comes before a white space does not change
# the matches after it: the only look-around of the pattern looks ahead, inside runs of white space.
SAFE = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n\t\r])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tokenizer of a rank file (lines of base64 token and rank), one per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, each ending at a safe boundary."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= PART:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]


def bpe_round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                   with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids array<int> and decoded binary.

    Special tokens are not recognised. A null text counts as empty (no tokens); repeated rows give repeated
    results; an empty table gives no rows; other columns are not read. ``rank_file`` must exist at the same place
    on every executor.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())]
    kind = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        fields += [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]
        kind += ", ids array<int>, decoded binary"
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                ids = encode_text(enc, value.as_py() or "")
                decoded = enc.decode_bytes(ids)
                row = (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                       hashlib.sha256(decoded).hexdigest())
                rows.append(row + ((ids, decoded) if with_ids else ()))
            columns = list(zip(*rows)) if rows else [[] for _ in fields[1:]]
            arrays = [batch.column("id")] + [pa.array(c, f[1]) for c, f in zip(columns, fields[1:])]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return narrow(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string")).mapInArrow(run, kind)


def bpe_decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
               ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (binary) for rows of token ids; null ids decode to nothing."""
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            decoded = [enc.decode_bytes(ids.as_py() or []) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(decoded, pa.binary())], schema=schema)

    return narrow(tokens, id=tokens[id_col].cast("long"), ids=tokens[ids_col].cast("array<int>")).mapInArrow(
        run, "doc_id long, decoded binary")


def public_bpe(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op9_bpe_round_trip")
def op9_bpe_round_trip(spark, sf_dir):
    """Token counts and digests of every document, encoded and decoded again."""
    return public_bpe(table(spark, sf_dir, "documents"))
