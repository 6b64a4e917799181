import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_suffix import brute as repeated
from tests.llm.test_toxicity import BAD, corpus
from tidemill.llm import packing
from tidemill.llm.common import Scratch

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled texts, then planted cases: copies, near copies, shared lines and passages, toxic texts, nulls."""
    rnd = random.Random(11)
    rows, labels = corpus(300)
    labels = [(i, q, t) for i, q, t in labels]
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(3000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [t for _, t, _ in rows]
    long = [say(120) + "\n" + say(80) for _ in range(6)]
    long[0] = say(200)
    texts += long  # 300 to 305
    near = long[0].split(" ")
    near[20], near[90] = "changed", "words"
    texts += [" ".join(near), long[1], long[2] + "\n" + say(60), say(40) + " " + long[3][100:500] + " " + say(40), say(30) + f" {BAD[0]} {BAD[1]} " + say(30), None, "", "short"]
    docs = [(i, t, None if i == 300 else "en", "s", len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    seen = [{r.doc_id: r.text for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r.n_chars == len(r.text or "") for r in rows)
        assert len({r.doc_id for r in rows}) == len(rows)
        seen.append({r.doc_id: r.text for r in rows})
        docs = spark.createDataFrame(rows, COLUMNS)
    start, clean, lines, near, cut = seen
    # clean documents stay, toxic ones go
    assert 310 not in clean and len(toxic & clean.keys()) <= 0.05 * len(toxic)
    assert len(start.keys() - clean.keys() - toxic - {310}) <= 3
    # a copy has no line of its own, a document with two lines of another keeps the rest
    assert 307 not in lines and lines[308] == start[308].split("\n")[-1] and lines[311] is None and lines[312] == ""
    assert all(lines[i] == start[i] for i in (300, 301, 302, 303, 304, 305))
    # of near copies the first stays; texts without words count as copies of each other
    assert 306 in lines and 306 not in near and 300 in near and lines.keys() - near.keys() == {306, 312}
    # repeated bytes go, as brute force says
    want = {r[0]: r for r in repeated([(i, t) for i, t in near.items()])}
    assert {i for i, t in near.items() if t and want[i][2]} == {i for i in near if near[i] and cut.get(i) != near[i]} and want[309][2] >= 390
    assert all(len((cut.get(i) or "").encode()) == want[i][1] - want[i][2] for i in near)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == cut.keys()
    for i in cut:
        own = sorted((r for r in packed if r.doc_id == i), key=lambda r: r.start)
        assert [r.length for r in own] == packing.lengths(own[0].doc_tokens, 2048)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 300
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_last_stage_holds_the_sequences(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 40")
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert rows and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32 for r in rows)


def test_stages_keep_columns_of_any_name(spark, folder):
    names = ["_key", "_id", "_removed", "_text", "_n", "_text_key", "score", "predicted", "a.b", "row", "key", "tid", "piece", "data", "null", "kept", "c0"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id between 295 and 312")
    docs = docs.select("*", *[F.concat(F.lit(n + " "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(list(r)[5:] == [f"{n} {r.doc_id}" for n in names] for r in rows), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() >= 18


def test_run_leaves_only_its_result(spark, folder):
    before = {*Scratch.alive}
    corpus_pipeline.run(spark, folder)
    assert [p.rsplit("-", 1)[-1] for p in Scratch.alive.keys() - before] == ["packing"]
