"""A quality classifier of texts through pyspark.ml, with calibrated scores.

Features are measures of a text (words, lines, lengths, shares of kinds of characters, repeats), computed by SQL
functions, and hashed counts of its words. A logistic regression learns from three folds of the labelled documents,
classes weighing the same; an isotonic regression on a fourth turns its margin into a share of good documents;
the fifth is held out. Folds go by the CRC-32 of the id, modulo 5: 0 is held out, 1 calibrates.

Learning and calibrating read all labelled documents of their folds, and all documents are scored. Labels are sent to all executors up to
a number of rows; beyond it Spark's own broadcast threshold decides whether they are sent or shuffled with the texts. Features of the labelled texts, and not their words, are what is kept for the passes of the regression.
Null texts are empty. Rows without id are scored and never learned from; of ids with several labels the largest counts. An empty table gives nothing. Without
labels of both classes in the learning folds, or without any in the calibrating one, there is no model: an error says so.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.joins import small

#: Labels up to which they are sent to all executors; two numbers each.
SENT = 500_000
HASHED = 4096
MEASURES = ["n_words", "mean_word", "distinct", "n_lines", "distinct_lines", "mean_line", "letters", "digits", "capitals", "blanks", "stops", "others"]


def fold(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, words and the measures of each text. Shares are of its characters, of all words or of all lines."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.array_remove(F.split(F.lower(text), r"\s+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "").alias("lines"), F.greatest(F.char_length(text), F.lit(1)).alias("size"),
    )
    # runs and not characters are taken out, and for letters all but them: a replacement costs more than what it takes out
    left = lambda pattern: (F.char_length("text") - F.char_length(F.regexp_replace("text", pattern, ""))) / F.col("size")
    n, lines = F.greatest(F.array_size("words"), F.lit(1)), F.greatest(F.array_size("lines"), F.lit(1))
    kinds = {"digits": r"[0-9]+", "capitals": r"\p{Lu}+", "blanks": r"\s+", "stops": r"[.!?]+"}
    measures = {
        "n_words": F.log1p(F.array_size("words")), "mean_word": F.char_length(F.array_join("words", "")) / n,
        "distinct": F.array_size(F.array_distinct("words")) / n, "n_lines": F.log1p(F.array_size("lines")),
        "distinct_lines": F.array_size(F.array_distinct("lines")) / lines, "mean_line": F.log1p(F.col("size") / lines),
        "letters": F.char_length(F.regexp_replace("text", r"\P{L}+", "")) / F.col("size"), **{k: left(p) for k, p in kinds.items()},
    }
    out = cut.select("doc_id", "words", *[c.alias(k) for k, c in measures.items()])
    return out.withColumn("others", 1 - F.col("letters") - F.col("digits") - F.col("blanks") - F.col("stops"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[PipelineModel, IsotonicRegressionModel]:
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("label"))
    known = small(known.where(fold() != 0), SENT)
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id", "left_semi")  # only these are measured
    featured = [HashingTF(inputCol="words", outputCol="hashed", numFeatures=HASHED, binary=True), VectorAssembler(inputCols=[*MEASURES, "hashed"], outputCol="features")]
    rows = PipelineModel(featured).transform(measured(asked).join(known, "doc_id")).select("label", fold().alias("fold"), "features").cache()
    try:
        sizes = {(r["fold"], r["label"]): r["count"] for r in rows.groupBy("fold", "label").count().collect()}  # at most four folds and the classes
        by = {c: sum(n for (f, x), n in sizes.items() if f > 1 and x == c) for c in (0.0, 1.0)}
        if not all(by.values()) or not any(f == 1 for f, _ in sizes):
            raise ValueError("labels of both classes are needed in the learning folds, and some in the calibrating one")
        weight = F.when(F.col("label") == 1, sum(by.values()) / (2 * by[1.0])).otherwise(sum(by.values()) / (2 * by[0.0]))
        learned = LogisticRegression(weightCol="weight", regParam=0.05, elasticNetParam=0.0, maxIter=50).fit(rows.where("fold > 1").withColumn("weight", weight))
        margins = learned.transform(rows.where("fold = 1")).select(F.col("label"), vector_to_array("rawPrediction")[1].alias("features"))
        return PipelineModel([*featured, learned]), IsotonicRegression().fit(margins)
    finally:
        rows.unpersist()


def judge(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """For each row of docs: doc_id, held_out, score (the calibrated share of good documents), predicted (1 if margin > 0)."""
    model, isotonic = train(docs, labels, label)
    found = model.transform(measured(docs)).select("doc_id", (F.coalesce(fold(), F.lit(-1)) == 0).alias("held_out"), vector_to_array("rawPrediction")[1].alias("features"))
    return isotonic.transform(found).select("doc_id", "held_out", F.col("prediction").alias("score"), (F.col("features") > 0).cast("int").alias("predicted"))
