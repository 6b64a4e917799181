"""Weights by bit planes equal plain sums, draws equal a plain ranking, and odd tables have the stated results."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import resample


def plain(docs, target, percent=10, buckets=10_000, seed=2024, least=20, grams=1):
    """doc_id, n_features, weight, score, rank as a plain program has them."""

    def found(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]
        return [zlib.crc32(w.encode()) % buckets for w in runs]

    own, aim = Counter(b for _, t in docs for b in found(t)), Counter(b for t in target for b in found(t))
    s, t = own.total(), aim.total()
    gain = [math.floor(1000 * math.log((aim[b] + 1.0) * (s + buckets) / ((own[b] + 1.0) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found(text))
        rows.append((i, len(found(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = percent * len(order) // 100
    out = [(*r, k if k <= drawn else None) for k, r in enumerate(order, 1)] + [(*r, None) for r in rows if r[1] < least]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@given(st.lists(st.lists(st.integers(0, 150), max_size=300), min_size=1, max_size=8), st.lists(st.integers(-(2**14), 2**14), min_size=151, max_size=151))
@settings(max_examples=60, deadline=None)
def test_weights(found, gain):
    found, gain = [np.array(x, np.int64) for x in found], np.array(gain)
    assert resample.weigh(found, *resample.gain_planes(gain)).tolist() == [int(gain[x].sum()) for x in found]


def test_planes_of_extreme_gains():
    for gain in ([0], [-1], [1], [-(2**13)], [2**13 - 1, -(2**13)], [0] * 64 + [5]):
        gain = np.array(gain)
        planes, worth = resample.gain_planes(gain)
        bits = np.unpackbits(planes.view(np.uint8), axis=1, bitorder="little")[:, : len(gain)].astype(np.int64)
        assert (bits.T @ np.array(worth)).tolist() == gain.tolist()


TEXTS = ["the gpl word word word " * 9, "Ünder  THE sea-side 42 " * 8, None, "", "few words", "x " * 30_000, "word " * 25, "word " * 25, "mit Mit MIT " * 10, "zzz yyy " * 12]


@pytest.mark.parametrize("grams", [1, 2])
def test_equals_a_plain_version(spark, grams):
    docs = [(i, TEXTS[i % len(TEXTS)] if i % 7 else f"{TEXTS[0]} {i}") for i in range(60)]
    docs += [(None, TEXTS[0]), (None, TEXTS[6]), (3, TEXTS[0]), docs[1], docs[1]]
    target = ["the word the sea", None, "mit mit"]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows(resample.report(df, aim, 30, grams)) == plain(docs, target, 30, grams=grams)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(i, "a b c " * 10) for i in range(20)], "doc_id long, text string")
    assert resample.report(none, docs).collect() == []
    assert resample.sample(none, docs).collect() == []
    assert rows(resample.report(docs, none)) == plain([(i, "a b c " * 10) for i in range(20)], [])


def test_sample_keeps_columns(spark):
    docs = [(i, f"word{i} " * 30, i * 2, "k", None) for i in range(40)] + [(5, "word5 " * 30, 10, "k", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score long, `a.b` string, row int")
    aim = spark.createDataFrame([("word5 word7",)], "text string")
    drawn = {r.doc_id for r in resample.report(df, aim).where("rank is not null").collect()}
    got = resample.sample(df, aim)
    assert got.columns == df.columns and 7 in drawn
    assert sorted(map(tuple, got.collect())) == sorted(d for d in docs if d[0] in drawn)
