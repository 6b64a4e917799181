"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios, trained here.

A text's features are the runs of 3 to 6 of its characters (lower-cased, white space as one space, a space at either
end), hashed into 2**18 slots for each length; each counts once, wherever in the text it stands. For training,
Spark counts in how many toxic and other texts each feature occurs; those with the most informative log-count ratios
are kept, scaled by that ratio, and get weights by logistic regression. The labelled rows used are a bounded sample:
up to `sample` rows of each class, those whose ids hash lowest; both classes weigh the same.

Null and empty texts are scored like any other (they have the feature of the two spaces at most). Rows with null labels or ids
aren't learnt from. If one class has no labelled row, every score is that class's share (0.5 without any label).
Of several rows with one labelled id, the least text is learnt from, once for each label. Repeated rows are scored alike.
Extra columns, whatever their names, are kept by score() and accepted() and ignored elsewhere. A very long text needs
memory for the slots of all its n-grams. An empty documents table gives nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemill.llm.common import Scratch, columns, free_name, numbered

SIZES = (3, 4, 5, 6)
SLOTS = 18
STEP = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(text: str | None) -> np.ndarray:
    """The slots of all n-grams, repeats included."""
    data = f" {' '.join((text or '').lower().split())} "
    b = np.frombuffer(data.encode("latin-1"), np.uint8) if data.isascii() else np.frombuffer(data.encode("utf-32-le", "surrogatepass"), "<u4")
    b = b.astype(np.uint64)
    code, out = b, []
    for n in range(2, max(SIZES) + 1):
        if len(b) < n:
            break
        code = code[:-1] * STEP + b[n - 1 :]
        if n in SIZES:
            out.append(((code * MIX) >> np.uint64(64 - SLOTS)).astype(np.int32) + np.int32(SIZES.index(n) << SLOTS))
    return np.concatenate(out) if out else np.empty(0, np.int32)


@dataclass
class Model:
    """weights: of each slot, ratios included."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        slots = grams(text)
        slots = np.unique(slots[self.weights[slots] != 0])
        z = float(self.weights[slots].sum(dtype=np.float64)) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit_weights(slots: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, steps: int = 200, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features times ratio, by accelerated gradient steps; every class weighs the same.
    slots: of each row, as places in ratio."""
    size = np.array([len(s) for s in slots])
    flat = np.concatenate(slots)
    row = np.repeat(np.arange(len(slots)), size)
    share = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum()))
    power = np.bincount(row, weights=ratio[flat] ** 2, minlength=len(slots))
    rate = 1.0 / (0.25 * float(np.quantile(power, 0.95)) + 1.0)
    w = ahead = np.zeros(len(ratio))
    b = ahead_b = 0.0
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=(ahead * ratio)[flat], minlength=len(slots)) + ahead_b
        error = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - toxic)
        grad = np.bincount(flat, weights=error[row], minlength=len(ratio)) * ratio + ridge * ahead
        new, new_b = ahead - 4 * rate * grad, ahead_b - 0.5 * error.sum()
        ahead, ahead_b = new + (t - 1) / (t + 2) * (new - w), new_b + (t - 1) / (t + 2) * (new_b - b)
        w, b = new, new_b
    return w * ratio, b


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, features: int = 8_000) -> Model:
    """Learns from the rows of labels that aren't held out (see held_out); docs gives their texts."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held_out())
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    weights = np.zeros(len(SIZES) << SLOTS, np.float32)
    if not (totals.get(0) and totals.get(1)):
        p = 0.5 if not totals else float(min(0.99, max(0.01, 1 in totals)))
        return Model(weights, float(np.log(p / (1 - p))))
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # at most 2 * sample rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # one text for each labelled id, so that the bound holds for rows as well; few tasks, as each counts into an array of all slots
    rows = scratch.write("labelled", found.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).repartition(8))

    size = len(weights)

    def count(batches):
        counts = np.zeros((2, size), np.int32)
        for b in batches:
            for text, y in zip(b.column("text"), b.column("toxic").to_pylist()):
                counts[y, np.unique(grams(text.as_py()))] += 1
        used = np.flatnonzero(counts.any(0))
        for i in range(0, len(used), 100_000):
            part = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[1, part], pa.int64()), pa.array(counts[0, part], pa.int64())], names=["slot", "toxic", "other"])

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        scratch.drop("labelled")
        p = totals[1] / (totals[0] + totals[1])
        return Model(weights, float(np.log(p / (1 - p))))
    ratio = F.log((F.col("toxic") + 1) / (n[1] + 2)) - F.log((F.col("other") + 1) / (n[0] + 2))
    # how far the counts speak for one class
    weight = F.abs(ratio) * F.pow(F.col("toxic") + F.col("other"), F.lit(0.35))
    kept = rows.mapInArrow(count, "slot int, toxic long, other long").groupBy("slot").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic + other >= 3")
    kept = kept.select("slot", ratio.alias("ratio"), weight.alias("_weight")).orderBy(F.desc("_weight"), "slot").limit(features).toPandas().sort_values("slot")
    slots, ratios = kept["slot"].to_numpy(np.int32), kept["ratio"].to_numpy(np.float64)
    if not len(slots):
        scratch.drop("labelled")
        return Model(weights, 0.0)

    def select(batches):
        for b in batches:
            found = []
            for text in b.column("text"):
                own = np.unique(grams(text.as_py()))
                at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
                found.append(at[slots[at] == own].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(found, pa.binary())], names=["toxic", "slots"])

    # at most 2 * sample rows, each of at most `features` numbers
    got = rows.orderBy("doc_id").select("toxic", "text").mapInArrow(select, "toxic int, slots binary").collect()
    scratch.drop("labelled")
    toxic = np.array([r["toxic"] for r in got])
    w, b = fit_weights([np.frombuffer(r["slots"], "<i4") for r in got], toxic, ratios)
    weights[slots] = w
    return Model(weights, b)


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score and the predicted label under these names to all columns of docs; columns that are called so
    already are replaced."""
    docs = docs.select(*columns(docs, *names))
    inner, at = numbered(docs), docs.columns.index("text")
    own = [*inner.columns, "score", "predicted"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: the slots

    def run(batches):
        m = sent.value
        for b in batches:
            s = [m.score(t.as_py()) for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=own)

    schema = StructType([*inner.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return inner.mapInArrow(run, schema).toDF(*docs.columns, *names)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, with their own columns, whatever these are called."""
    names = free_name(docs, "score"), free_name(docs, "predicted")
    return score(docs, model, names).where(F.col(names[1]) == 0).select(*columns(docs))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: whether it is held out from training, and its score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
