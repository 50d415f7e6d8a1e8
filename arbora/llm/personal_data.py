"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton finds the anchors: at-signs, plus signs, digits, schemes and identifier cues.
From an anchor a small deterministic parser walks to both ends of the item and validates it. Only the
characters around anchors are looked at again, so a text of any length is read once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from arbora.llm.common import narrow, register, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "account", "secret")
KINDS = BASE + ADDED

# What announces an address with credentials, an account number, a secret.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "tax id", "customer id", "member id", "patient id")
SECRET_CUES = ("token", "api_key", "apikey", "api key", "secret", "password", "passwd")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_FOUR = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_RUN = re.compile(r"[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIAL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOGIN = re.compile(r"[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+")
_ACCOUNT = re.compile(
    r"(?:[\x20\t]*(?:number|no\.?|nr\.?|id))?[\x20\t]*[:#=]?[\x20\t]*([A-Z]{0,4}[0-9](?:[\x20-]?[A-Z0-9]){5,33})(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\x20\t]*[:=][\x20\t]*[\"']?([A-Za-z0-9+/_=.-]{12,})")


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for mark in ("@", "+", *sorted(_DIGITS)):
        automaton.add_word(mark, ("digit" if mark in _DIGITS else mark, 1))
    for kind, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.capitalize()}:
                automaton.add_word(form, (kind, len(form)))
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def iban(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _account(value: str) -> bool:
    """An IBAN must pass its check; other numbers need six digits."""
    plain = re.sub(r"[\x20-]", "", value)
    if re.match(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}$", plain):
        return iban(plain)
    return sum(c in _DIGITS for c in plain) >= 6


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, sorted by start, then kind as listed. Per kind, spans do not overlap.

    Matches of a kind are leftmost and non-overlapping; one that fails its check is dropped with its characters.
    """
    out: list[tuple[int, int, str]] = []
    free = dict.fromkeys(KINDS, 0)
    size = len(text)
    for last, (kind, length) in anchors().iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= free["card"]:
                chain = _CHAIN.match(text, at)
                free["card"] = chain.end() if chain else at + 1
                if chain and 14 <= sum(c in _DIGITS for c in chain.group()) <= 19:
                    if luhn("".join(c for c in chain.group() if c in _DIGITS)):
                        out.append((at, chain.end(), "card"))
            if at >= free["ip"]:
                four = _FOUR.match(text, at)
                free["ip"] = four.end() if four else _RUN.match(text, at).end()
                if four and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four.groups()):
                    out.append((at, four.end(), "ip"))
        elif kind == "@":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                free["email"] = domain.end()
                out.append((start, domain.end(), "email"))
        elif kind == "+":
            dial = _DIAL.match(text, at)
            if dial and 10 <= sum(c in _DIGITS for c in dial.group()) <= 15:
                out.append((at, dial.end(), "phone"))
        elif kind == "scheme":
            login = _LOGIN.match(text, last + 1)
            if login and login.start() >= free["login"]:
                free["login"] = login.end()
                out.append((login.start(), login.end(), "login"))
        elif (at == 0 or not text[at - 1].isalnum()) and (last + 1 >= size or not text[last + 1].isalpha()):
            item = (_ACCOUNT if kind == "account" else _SECRET).match(text, last + 1)
            if item and item.start(1) >= free[kind] and (kind == "secret" or _account(item.group(1))):
                free[kind] = item.end(1)
                out.append((item.start(1), item.end(1), kind))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[0], order[s[2]]))


def redact(text: str, mark: str = "<{}>") -> str:
    """``text`` with every span replaced by its kind; of overlapping spans the first stands for all."""
    parts, at = [], 0
    for start, end, kind in find_spans(text):
        if start >= at:
            parts += [text[at:start], mark.format(kind)]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       redacted: bool = False) -> DataFrame:
    """doc_id, a count per base kind, base_sha256, spans ("kind:start:end" comma-joined), a count per added kind,
    and with ``redacted`` the text with all spans replaced.

    A null text counts as empty; repeated rows give repeated results, an empty table none; other columns are not
    read.
    """
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", *[f"n_{k}" for k in ADDED]]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * len(ADDED)
    if redacted:
        names, types = [*names, "text"], [*types, pa.string()]
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = find_spans(text)
                count = dict.fromkeys(KINDS, 0)
                for _, _, kind in found:
                    count[kind] += 1
                base = ",".join(f"{k}:{a}:{b}" for a, b, k in found if k in BASE)
                row = [*[count[k] for k in BASE], hashlib.sha256(base.encode()).hexdigest(),
                       ",".join(f"{k}:{a}:{b}" for a, b, k in found), *[count[k] for k in ADDED]]
                rows.append(row + ([redact(text)] if redacted else []))
            columns = list(zip(*rows)) if rows else [[]] * (len(names) - 1)
            yield pa.record_batch([batch.column("id"), *[pa.array(c, t) for c, t in zip(columns, types[1:])]],
                                  schema=schema)

    kind = ", ".join(f"{n} {'long' if t == pa.int64() else 'string'}" for n, t in zip(names, types))
    return narrow(docs, id=docs[id_col].cast("long"), text=docs[text_col].cast("string")).mapInArrow(run, kind)


@register("op5_personal_data")
def op5_personal_data(spark, sf_dir):
    """Personal data in every document."""
    return find_personal_data(table(spark, sf_dir, "documents"))
