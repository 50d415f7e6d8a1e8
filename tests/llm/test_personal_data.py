import hashlib
import random
import re

from arbora.llm.personal_data import BASE, find_personal_data, find_spans, iban, luhn, redact
from conftest import awkward_rows


def brute(text):
    """The base kinds by regular expressions over the whole text."""
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def test_base_spans_of_random_texts():
    rng, found = random.Random(2), 0
    for k in range(20_000):
        letters = "4111 11-1.@+" if k % 3 == 0 else "aB1234567890..@@+- ()é%_ x\n"
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        want = brute(text)
        assert [s for s in find_spans(text) if s[2] in BASE] == want
        found += len(want)
    assert found > 1000


def test_added_kinds():
    text = 'IBAN DE89 3704 0044 0532 0130 00, token = "abcdef0123456789", https://bob:pw@host.com/x, account no. 12345678'
    kinds = {text[a:b]: k for a, b, k in find_spans(text)}
    assert kinds["DE89 3704 0044 0532 0130 00"] == "account" and kinds["abcdef0123456789"] == "secret"
    assert kinds["bob:pw@host.com"] == "login" and kinds["12345678"] == "account"
    assert find_spans("on account of 3 tokens; http://plain.example.com/page, the accountant 123456") == []
    assert iban("DE89370400440532013000") and not iban("DE88370400440532013000")
    assert redact("mail a.b@c.de now") == "mail <email> now"


def test_table(spark, awkward, nothing, documents):
    texts = {r.doc_id: r.text for r in documents.itertuples()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    total = 0
    for r in find_personal_data(docs, redacted=True).collect():
        want = brute(texts[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in want) for k in BASE]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        total += len(want)
    assert total > 0
    assert find_personal_data(awkward).count() == len(awkward_rows())
    assert find_personal_data(nothing).count() == 0


def test_long_texts_are_read_once():
    assert len(find_spans("1" * 200_000 + " " + "a@" * 50_000 + "+1" * 50_000 + "1.2" * 50_000)) >= 0
