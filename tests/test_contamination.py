"""Overlaps equal a plain search; hot grams, short items, odd tables."""

import math
import random
import re

import pytest

from tidemill.operators import contamination
from tidemill.sources.tables import clear


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size):
    texts = {}
    for i, t in items:
        if i is not None:
            texts[i] = min((x for x in (texts.get(i), t) if x is not None), default=None)
    own = {}
    for i, t in docs:
        own.setdefault(i, []).append(words(t))
    found = {}  # of each item its grams by place
    for i, t in texts.items():
        w = words(t)
        n = min(size, len(w))
        found[i] = (n, len(w), [tuple(w[k : k + n]) for k in range(len(w) - n + 1)] if w else [])
    held = {d: {tuple(w[k : k + n]) for w in lists for n in {f[0] for f in found.values() if f[0]} for k in range(len(w) - n + 1)} for d, lists in own.items()}
    df = {g: sum(g in h for h in held.values()) for f in found.values() for g in f[2]}
    weight = {g: math.floor(1000.0 * math.log((len(own) + 1.0) / (n + 1.0))) + 1 for g, n in df.items()}
    out = []
    for d, h in held.items():
        for i, (n, long, grams) in found.items():
            hit = {g for g in grams if g in h}
            if hit:
                covered = {k + j for k, g in enumerate(grams) if g in h for j in range(n)}
                out.append((d, i, len(hit), len({*grams}), len(covered), long, 1000 * len(covered) // long, 1000 * sum(weight[g] for g in hit) // sum(weight[g] for g in {*grams})))
    return sorted(out, key=repr)


def tables(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(k, say(rng.choice([30, 60]))) for k in range(12)] + [(20, "Short Item"), (21, None), (22, "..."), (23, "été one"), (24, "la la la la la la la la la la la la"), (0, "zz top"), (None, "no id")]
    docs = []
    for k in range(80):
        text = say(rng.choice([0, 5, 200]))
        if k % 3 == 0:
            w = (items[k % 12][1] or "").split()
            a = rng.randrange(20)
            text += " " + " ".join(w[a : a + rng.randrange(40)]).upper() + ". " + say(10)
        docs.append((k, text))
    docs += [(100, "a short, item! of ÉTÉ one été one"), (101, None), (101, "short"), (101, "item la la la la la la la la la"), (None, "short item"), (None, "other"), (102, items[3][1] * 2), (103, " ".join(items[4][1].split()) + " x" * 20_000)]
    return docs, items, spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, `a.b` string").repartition(4), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("sent,hot", [(500_000, 10_000), (0, 3)])
def test_equals_a_plain_search(spark, monkeypatch, sent, hot):
    """Also with shuffled tables and grams that several tasks share."""
    monkeypatch.setattr(contamination, "SENT", sent)
    monkeypatch.setattr(contamination, "HOT", hot)
    docs, items, df, bench = tables(spark)
    got = sorted((tuple(r) for r in contamination.overlaps(df, bench).collect()), key=repr)
    assert got == plain(docs, items, 8) and len(got) > 20
    clear()


def test_report_and_clean(spark):
    docs, items, df, bench = tables(spark)
    found = plain(docs, items, 5)
    report = {r.item_id: r for r in contamination.item_report(df, bench, 5, 600).collect()}
    assert report.keys() == {i for i, _ in items if i is not None}
    for i, r in report.items():
        own = [x for x in found if x[1] == i]
        best = max((x[6] for x in own), default=0)
        assert (r.n_docs, r.n_contaminated, r.best_milli) == (len(own), sum(x[6] >= 600 for x in own), best)
        assert r.first_doc == min((x[0] for x in own if x[6] == best and x[0] is not None), default=None)
    bad = {x[0] for x in found if x[6] >= 600}
    kept = contamination.clean(df, bench, 5, 600)
    assert kept.columns == df.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == sorted((d for d in docs if d[0] not in bad), key=repr) and {None, 102, 103} <= bad
    clear()


def test_empty_tables(spark):
    docs, items, df, bench = tables(spark)
    assert contamination.overlaps(df.limit(0), bench).collect() == [] and contamination.overlaps(df, bench.limit(0)).collect() == []
    assert contamination.clean(df, bench.limit(0)).count() == len(docs)
    assert {(r.n_docs, r.first_doc) for r in contamination.item_report(df.limit(0), bench).collect()} == {(0, None)}
    clear()
