import random
import zlib

import numpy as np
import pytest

from tidemill.llm import toxicity

BAD = ["glorp", "snarf", "vexil"]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 80))]
        toxic = rnd.random() < 0.3
        if toxic:
            for _ in range(2):
                text.insert(rnd.randrange(len(text)), rnd.choice(BAD) + rnd.choice(["", "s", "ed"]))
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(500)
    rows += [(500, None, None), (501, "", "x"), (None, "glorp snarf", "x"), (502, "word " * 300_000 + "glorps", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (501, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.judge(docs, known).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert [r.predicted for r in got if r.doc_id in (None, 502)] == [1, 1]


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = []
    for flip in (False, True):
        known = spark.createDataFrame([(i, q, 1 - t if flip and held(i) else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
        scores.append(toxicity.train(docs, known).weights)
    assert (scores[0] == scores[1]).all()


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.judge(docs, none).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, toxic int")
    assert all(r.score > 0.9 for r in toxicity.judge(docs, one).collect())
    assert toxicity.judge(docs.limit(0), none).count() == 0


def test_repeated_documents_dont_multiply_the_sample(spark):
    rows, labels = corpus(60)
    docs = spark.createDataFrame([r for r in rows for _ in range(20)], "doc_id long, text string, x string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    once = toxicity.train(docs.dropDuplicates(["doc_id"]), known)
    many = toxicity.train(docs, known)
    assert (once.weights == many.weights).all() and once.bias == many.bias


@pytest.mark.parametrize("name", ["score", "predicted", "Score", "a.b", "c0"])
def test_accepted_keeps_columns_of_any_name(spark, name):
    rows, labels = corpus(120)
    docs = spark.createDataFrame([(i, t, 7.5) for i, t, _ in rows], f"doc_id long, text string, `{name}` double")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = toxicity.accepted(docs, model)
    assert out.columns == ["doc_id", "text", name]
    kept = out.collect()
    assert {r[2] for r in kept} == {7.5}
    assert sorted(r[0] for r in kept) == sorted(i for i, t, _ in rows if model.score(t) < 0.5)


def test_weights_against_a_plain_version(spark):
    """The same slots, ratios and gradient steps, worked out on one machine without Spark."""
    rows, labels = corpus(150, 3)
    texts = {i: t for i, t, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, x string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    used = sorted((i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5)
    sets = {i: set(toxicity.grams(texts[i]).tolist()) for i, _ in used}
    n = [sum(y == k for _, y in used) for k in (0, 1)]
    counts = {}
    for i, y in used:
        for s in sets[i]:
            counts.setdefault(s, [0, 0])[y] += 1
    ratio = {s: np.log((c[1] + 1) / (n[1] + 2)) - np.log((c[0] + 1) / (n[0] + 2)) for s, c in counts.items() if sum(c) >= 3}
    best = sorted(ratio, key=lambda s: (-round(abs(ratio[s]) * sum(counts[s]) ** 0.35, 9), s))[:8000]
    slots = np.array(sorted(best))
    x = np.array([[s in sets[i] for s in slots.tolist()] for i, _ in used], float) * np.array([ratio[s] for s in slots.tolist()])
    y = np.array([y for _, y in used])
    share = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    rate = 1 / (0.25 * np.quantile((x**2).sum(1), 0.95) + 1)
    w = ahead = np.zeros(len(slots))
    b = ahead_b = 0.0
    for t in range(1, 201):
        error = share * (1 / (1 + np.exp(-(x @ ahead + ahead_b))) - y)
        new, new_b = ahead - 4 * rate * (x.T @ error + 2e-4 * ahead), ahead_b - 0.5 * error.sum()
        ahead, ahead_b = new + (t - 1) / (t + 2) * (new - w), new_b + (t - 1) / (t + 2) * (new_b - b)
        w, b = new, new_b
    want = np.zeros(len(model.weights))
    want[slots] = w * np.array([ratio[s] for s in slots.tolist()])
    same = np.isclose(model.weights, want, atol=1e-4)
    assert same.mean() > 0.999 and abs(model.bias - b) < 1e-3
    for i, _ in used[:40]:
        assert abs(model.score(texts[i]) - 1 / (1 + np.exp(-(want[sorted(sets[i])].sum() + b)))) < 1e-3
