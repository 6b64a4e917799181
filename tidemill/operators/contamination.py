"""Benchmark contamination: which documents hold how much of which benchmark item.

Words are runs of digits, letters a-z (A-Z lower-cased) and anything beyond ASCII. An item's grams are its runs of `size`
words; an item of fewer words has one gram, all of them; without words it has none and is in no document. A document holds an item's gram if its words
hold that run anywhere. A gram weighs floor(1000 ln((N + 1) / (df + 1))) + 1, with df the number of documents that hold it,
of N: phrases that are everywhere say little.

The grams of all items are an inverted index: hash, item, place. Documents are hashed to their distinct grams and joined with
the index's hashes; what is found is small and written once, and the weights are counted from it. The index is
broadcast up to a number of rows, else both sides are shuffled. Grams of very many documents are dealt to several tasks each
(salted), with their entries copied to each of these, before they meet the index's items. Grams are compared by 64-bit
hashes, so among very many a false hit is possible in principle.

Null texts have no words. Rows with equal doc_id are one document, and so are those without id; of rows with equal
item_id the text that sorts first counts, and items without id are left out. Very long texts are taken whole. Empty
tables give nothing. Other columns are ignored by overlaps() and item_report(), and kept by clean(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.joins import small
from tidemill.sources.tables import stored

#: Rows of the index up to which it is sent to all executors; 40 bytes each.
SENT = 500_000
#: Documents that hold a gram from which on it is dealt to several tasks, so many to each.
HOT = 10_000
CAPITALS, LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, LETTERS), BETWEEN), lambda w: w != "")


def grams(found: Column, size: Column | int) -> Column:
    """Hashes of the runs of so many words, by place; none if there are fewer words."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.sequence(F.lit(1), F.array_size(found) - size + 1)
    return F.when(F.array_size(found) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(found, i, size))))


def index(items: DataFrame, size: int) -> DataFrame:
    """item_id, at (from 0), gram, size, n_words, first: whether the gram stands at no earlier place of the item."""
    found = items.where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")).select("item_id", words(F.col("text")).alias("words")).withColumn("n_words", F.array_size("words")).where("n_words > 0")
    found = found.withColumn("size", F.least(F.lit(size), "n_words"))
    found = found.select("item_id", "n_words", "size", F.posexplode(grams(F.col("words"), F.col("size"))).alias("at", "gram"))
    return found.withColumn("first", F.row_number().over(Window.partitionBy("item_id", "gram").orderBy("at")) == 1)


def hits(docs: DataFrame, entries: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, gram: which documents hold which of the entries' grams, each pair once."""
    own = docs.select("doc_id", words(F.col("text")).alias("words"))
    none = F.array().cast("array<bigint>")
    every = F.concat(*[F.coalesce(grams(F.col("words"), n), none) for n in sizes]) if sizes else none
    each = own.select("doc_id", F.explode(F.array_distinct(every)).alias("gram"))
    return each.join(small(entries.select("gram").distinct(), SENT), "gram").distinct()


def weight(n: int, df: Column) -> Column:
    return (F.floor(F.lit(1000.0) * F.log(F.lit(n + 1.0) / (df.cast("double") + 1.0))) + 1).cast("long")


def _tables(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index with the grams' weights, what documents hold of it, and how many documents hold each gram."""
    entries = stored(index(items, size))
    sizes = sorted(r.size for r in entries.select("size").distinct().collect())  # at most `size` numbers
    found = stored(hits(docs, entries, sizes))
    n = docs.select("doc_id").distinct().count()
    held = stored(found.groupBy("gram").agg(F.count(F.lit(1)).alias("df")))
    df = F.coalesce("df", F.lit(0))
    entries = stored(entries.join(small(held, SENT), "gram", "left").withColumn("df", df).withColumn("weight", weight(n, df)))
    return entries, found, held


def overlaps(docs: DataFrame, items: DataFrame, size: int = 8) -> DataFrame:
    """For each document and item with a gram in common: doc_id, item_id; hits and grams: how many of the item's distinct grams
    the document holds, of how many; covered and words: how many of its words such grams cover, of how many;
    covered_milli and weight_milli: the shares of its words and of its grams' weight in thousandths, rounded down."""
    entries, found, held = _tables(docs, items, size)
    salts = small(held.where(F.col("df") > HOT).select("gram", F.ceil(F.col("df") / HOT).alias("salts")), SENT)
    spread = found.join(salts, "gram", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0).cast("long"))).drop("salts")
    copied = entries.join(salts, "gram", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    totals = entries.where("first").groupBy("item_id").agg(F.count(F.lit(1)).alias("grams"), F.sum("weight").alias("total"), F.max("n_words").alias("words"))
    met = spread.join(small(copied, SENT), ["gram", "salt"]).select("doc_id", "item_id", "at", "size", "first", "weight")
    after = F.lead("at").over(Window.partitionBy("doc_id", "item_id").orderBy("at"))
    met = met.withColumn("own", F.least(F.col("size"), F.coalesce(after - F.col("at"), F.col("size"))))
    pairs = met.groupBy("doc_id", "item_id").agg(F.count_if("first").alias("hits"), F.sum("own").alias("covered"), F.sum(F.when(F.col("first"), F.col("weight"))).alias("weight"))
    out = pairs.join(small(totals, SENT), "item_id")
    return out.select("doc_id", "item_id", "hits", "grams", "covered", F.col("words").cast("long").alias("words"), F.expr("1000 * covered div words").alias("covered_milli"), F.expr("1000 * weight div total").alias("weight_milli"))


def item_report(docs: DataFrame, items: DataFrame, size: int = 8, share: int = 500) -> DataFrame:
    """For each item_id: n_docs: documents that hold a gram of it; n_contaminated: those that cover at least `share` thousandths of
    its words; best_milli: the largest such share; first_doc: the smallest doc_id with it. Items that no document holds have 0, 0, 0 and null."""
    found = overlaps(docs, items, size)
    best = F.max(F.struct("covered_milli", (-F.col("doc_id")).alias("neg"))).alias("best")
    found = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("covered_milli") >= share).alias("n_contaminated"), best)
    none = F.lit(0).cast("long")
    out = items.where("item_id is not null").select("item_id").distinct().join(found, "item_id", "left")
    return out.select("item_id", F.coalesce("n_docs", none).alias("n_docs"), F.coalesce("n_contaminated", none).alias("n_contaminated"), F.coalesce("best.covered_milli", none).alias("best_milli"), (-F.col("best.neg")).alias("first_doc"))


def clean(docs: DataFrame, items: DataFrame, size: int = 8, share: int = 500) -> DataFrame:
    """docs without the documents that cover at least `share` thousandths of an item's words."""
    bad = small(stored(overlaps(docs, items, size).where(F.col("covered_milli") >= share).select(F.col("doc_id").alias("bad_id")).distinct()), SENT)
    # the row's own columns stay in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"))
    rows = rows.join(bad, F.col("own_id").eqNullSafe(F.col("bad_id")), "left_anti")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
