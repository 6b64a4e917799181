"""Spans of planted data, checksums against other ways to compute them, redaction; counts equal their SQL (test_fixtures)."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.operators import private

CARD, IBAN, TOKEN = "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "a94a8fe5ccb19ba61c4c0873d391e987982fbbd3"


@pytest.mark.parametrize("text,want", [
    ("mail a.b+c@mail.example.com.", [("email", "a.b+c@mail.example.com")]), ("no@mail", []), (f"pay {CARD} or 4111-1111-1111-1112", [("card", CARD)]), ("4111111111111111", [("card", "4111111111111111")]),
    ("call +1 (017) 555-7713 now", [("phone", "+1 (017) 555-7713")]), ("10.0.0.255 and 10.0.0.256", [("ip", "10.0.0.255")]), (f"to {IBAN}", [("iban", IBAN)]), ("GB83WEST12345698765432", []),
    (f'token = "{TOKEN}"', [("token", TOKEN)]), ("a" * 30 + "1" * 10, []), ("onlylettersthatgoonforverylong", []), ("-----BEGIN RSA PRIVATE KEY-----\nxyz", [("key", "-----BEGIN RSA PRIVATE KEY-----")]),
    ("é10.0.0.1é", [("ip", "10.0.0.1")]), (None, []), ("", []),
])
def test_spans_of_a_text(text, want):
    assert [(k, text[a:z]) for k, a, z in private.find(text)] == want


@given(st.integers(0, 10**18), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_luhn(number, last):
    digits = f"{number}{last}"
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    assert private.luhn(digits) == (sum(sum(map(int, str(d))) for d in doubled) % 10 == 0)
    assert sum(private.luhn(f"{number}{x}") for x in range(10)) == 1


def test_tables(spark):
    rng = random.Random(1)
    rows = [(1, f"x {CARD} y a@b.example.com {CARD}", "k"), (2, None, None), (None, "10.0.0.1", "n"), (3, "clean text", "k"), (1, "10.0.0.1", "k"), (4, "word " * 200_000 + "z@example.com", "l")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    got = {(r.doc_id, r.kind): (r.n, r.chars) for r in private.counts(df).collect()}
    assert got == {(1, "card"): (2, 38), (1, "email"): (1, 15), (None, "ip"): (1, 8), (1, "ip"): (1, 8), (4, "email"): (1, 13)}
    out = private.redact(df)
    assert out.columns == df.columns
    texts = sorted(((r.doc_id, r.text[-30:] if r.text else r.text) for r in out.collect()), key=repr)
    assert texts == sorted([(1, "x <CARD> y <EMAIL> <CARD>"), (2, None), (None, "<IP>"), (3, "clean text"), (1, "<IP>"), (4, ("word " * 10 + "<EMAIL>")[-30:])], key=repr)
    assert private.counts(df.limit(0)).collect() == [] and private.redact(df.limit(0)).collect() == []
