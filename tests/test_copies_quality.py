"""One of each text, also of one that a million rows hold; the classifier's held-out accuracy and calibration."""

import random
import zlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemill.operators import copies, joins, quality
from tidemill.sources.tables import clear


@pytest.mark.parametrize("sent", [500_000, 0])
def test_first_of_each(spark, monkeypatch, sent):
    monkeypatch.setattr(copies, "SENT", sent)
    rows = [(3, "a", "x"), (1, "a", "y"), (2, "b", "x"), (2, "b", "w"), (None, "b", "n"), (None, "c", "n"), (None, "c", "m"), (5, None, "x"), (4, None, "y"), (6, "", "x"), (7, "A", "x"), (1, "c2", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    got = copies.first_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "a", "y"), (2, "b", "w"), (None, "c", "m"), (4, None, "y"), (6, "", "x"), (7, "A", "x"), (1, "c2", "x")], key=repr)
    assert {(r.doc_id, r.n_copies) for r in copies.copies(df).collect()} == {(1, 2), (2, 3), (None, 2), (4, 2), (6, 1), (7, 1), (1, 1)}
    assert copies.first_of_each(df.limit(0)).collect() == [] and copies.copies(df.limit(0)).collect() == []
    clear()


def test_one_text_a_million_times(spark):
    """Each task sends one row of it, and the rows to drop are spread over the tasks by their ids."""
    df = spark.range(1_000_000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text")).unionByName(spark.range(5).select((F.col("id") + 2_000_000).alias("doc_id"), F.col("id").cast("string").alias("text")))
    assert sorted(r.doc_id for r in copies.first_of_each(df).collect()) == [0, *range(2_000_000, 2_000_005)]
    assert max(r.n_copies for r in copies.copies(df).collect()) == 1_000_000
    clear()


def texts(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        odd = rng.random() < 0.1  # a tenth are labelled against their looks
        said = [rng.choice(words) for _ in range(rng.randrange(10, 80))]
        if not good:
            said = [w + rng.choice(["###", "$$$", "!!!", " 12345"]) if rng.random() < 0.4 else w for w in said] + said[:5] * 4
        rows.append((i, " ".join(said)))
        labels.append((i, int(good != odd)))
    return rows, labels


def test_held_out_accuracy_and_calibration(spark):
    rows, labels = texts(2500, 3)
    docs = spark.createDataFrame([*rows, (None, "no id"), (9001, None), (9002, ""), (9003, "word " * 100_000)], "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([*labels, (None, 1), (9001, None)], "doc_id long, quality int")
    got = quality.judge(docs, known).collect()
    truth = dict(labels)
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 400 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.85
    # expected calibration error over ten bins
    bins = {}
    for r in held:
        bins.setdefault(min(9, int(r.score * 10)), []).append((r.score, truth[r.doc_id]))
    error = sum(abs(sum(s for s, _ in b) - sum(t for _, t in b)) for b in bins.values()) / len(held)
    assert error < 0.08


def test_held_out_labels_are_not_learned(spark):
    rows, labels = texts(400, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    one, two = ({r.doc_id: r.score for r in quality.judge(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, turned))
    assert one == two
    with pytest.raises(ValueError):
        quality.judge(docs, spark.createDataFrame([(i, 1) for i, _ in labels], "doc_id long, quality int"))


def test_training_measures_labelled_texts_only(spark, monkeypatch):
    """Folds 1 to 4 of the labelled ids, whatever else the table holds."""
    seen, plain = [], quality.measured
    monkeypatch.setattr(quality, "measured", lambda docs: (seen.append({r.doc_id for r in docs.collect()}), plain(docs))[1])
    rows, labels = texts(400, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    quality.train(docs, spark.createDataFrame(labels[:200], "doc_id long, quality int"))
    assert seen == [{i for i, _ in labels[:200] if zlib.crc32(str(i).encode()) % 5}]


def test_measures(spark):
    """As counted one character at a time."""
    said = ["Ab1 c.\u00c9\u00e9! 22\n\n \t?x", "", None, "  ", "\U0001d400\u4e2d3..A", "...", "word"]
    got = {r.doc_id: r for r in quality.measured(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()}
    for i, t in enumerate(t or "" for t in said):
        n, words = max(1, len(t)), t.lower().split()
        share = lambda test: sum(map(test, t)) / n
        want = [share(str.isalpha), share(lambda c: c in "0123456789"), share(str.isupper), share(str.isspace), share(lambda c: c in ".!?"), sum(map(len, words)) / max(1, len(words))]
        assert [got[i][k] for k in ("letters", "digits", "capitals", "blanks", "stops", "mean_word")] == pytest.approx(want) and got[i].words == words


def test_all_labels_are_learned_from(spark):
    """A word stands only in the labelled texts whose ids hash highest, behind more than 200,000 others."""
    ids = spark.range(300_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).where(quality.fold() != 0)
    by_hash = Window.orderBy(F.xxhash64("doc_id"))
    ids = ids.withColumn("late", F.row_number().over(by_hash) > 210_000)
    labels = ids.select("doc_id", F.when(F.col("late"), 0).otherwise(F.col("quality")).alias("quality"))
    docs = ids.select("doc_id", F.when(F.col("late"), "tardy").otherwise("early").alias("text"))
    model, isotonic = quality.train(docs, labels)
    seen = model.stages[-1].summary.predictions.count()
    asked = quality.measured(spark.createDataFrame([(0, "tardy"), (1, "early")], "doc_id long, text string"))
    tardy, early = (r.probability[1] for r in model.transform(asked).orderBy("doc_id").collect())
    assert seen == ids.where(quality.fold() > 1).count() and labels.count() > 235_000
    assert tardy < 0.2 < 0.45 < early


def test_labels_sent_or_shuffled(spark, monkeypatch):
    """The same rows either way, of ids with several labels or texts too."""
    rows, labels = texts(400, 11)
    docs = spark.createDataFrame([*rows, (1, "again"), (2, None), (None, "no id")], "doc_id long, text string").repartition(3)
    known = spark.createDataFrame([*labels, (1, 1), (2, 0), (7_000, 1), (None, 0)], "doc_id long, quality int")
    found = []
    for sent in (500_000, 0):
        monkeypatch.setattr(quality, "SENT", sent)
        monkeypatch.setattr(quality, "small", lambda df, n: joins.small(df, n) if n else df.hint("shuffle_hash"))
        found.append(sorted(((r.doc_id is None, r.doc_id, r.predicted, round(r.score, 6)) for r in quality.judge(docs, known).collect()), key=repr))
    assert found[0] == found[1] and len(found[0]) == len(rows) + 3
