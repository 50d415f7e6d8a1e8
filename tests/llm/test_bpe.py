import hashlib

import numpy as np
import public_tokenizers
import pytest

from arbora.llm.bpe import PART, bpe_decode, bpe_round_trip, encode_text, encoding, parts, public_bpe
from conftest import awkward_rows

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LONG = ["word " * 30_000, "a b\n\n c  \t" * 9_000, "é" * 50_000, " " * 60_000 + "x", "日本語 テキスト" * 8_000,
        "it's 12 o'clock\r\n" * 4_000, "\x1c \x85  x" * 9_000]


@pytest.mark.parametrize("text", LONG)
def test_parts_encode_like_the_whole(text):
    enc = encoding(FILE, PATTERN)
    assert "".join(parts(text)) == text
    assert len(text) > PART and encode_text(enc, text) == enc.encode_ordinary(text)


def test_round_trip(awkward):
    enc = encoding(FILE, PATTERN)
    got = public_bpe(awkward).collect()
    want = []
    for i, text, _, _ in awkward_rows():
        ids = enc.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_ids_decode_to_the_bytes(awkward):
    tokens = bpe_round_trip(awkward, FILE, PATTERN, with_ids=True)
    again = bpe_decode(tokens, FILE, PATTERN)
    assert sorted(bytes(r.decoded) for r in again.collect()) == sorted((t or "").encode() for _, t, _, _ in awkward_rows())


def test_empty_table(nothing):
    assert public_bpe(nothing).count() == 0
