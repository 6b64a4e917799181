"""Line dedup by a segment-partition edit join, with DataFrame and SQL functions only.

Lines are the parts of a text between line feeds, without white space at either end; blank ones don't count. Two lines
are near if their edit distance is at most `most`, both having at least `shortest` characters; shorter ones are only
compared for equality. An occurrence of a line is removed if an equal or near line stands earlier: in a document with
a smaller doc_id, or further up in the same one.

Join: a line of n characters is cut into most + 1 segments of like length. A line within `most` edits contains one of
them unchanged, at a place that the difference of the lengths and the segment's number bound. So each line is entered
under the hashes of (its length, segment number, segment) and looks up those of its substrings at the possible places
for every length from n - most to n.

1. One pass over the texts writes each line's hashes and place. Hashes that different lines have are found by an
   aggregation, so a line or segment that is repeated often is summed up before the shuffle.
2. The texts of lines that have such a hash are fetched, once for each distinct line. Lines that meet under a hash, and
   in which some letters occur about as often (each edit changes these numbers by two in all, at most), are pairs.
3. Under a hash that very many lines have, only those meet that share a segment of what is left of them without the
   first one, too: left and right of an unchanged segment there are no more edits than in the whole line.
4. Pairs are compared by the edit distance within a band of 2 * most + 1 diagonals, those of 3. inside their join.
   Lines of which very many agree in nearly everything (variants of one line) are compared in pairs, each pair of a
   line and a block of others in a task of its own, as every near pair counts.

Null texts have no lines and stay null; rows with null doc_id come after all others; rows with equal doc_id and text are
the same document and lose the same lines. Very long texts and lines are handled whole. Extra columns, whatever their
names, are kept by dedup() and ignored by report(). An empty table gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch

#: Letters whose numbers in two lines are compared before their texts are.
LETTERS = "etaniorsh "
#: Hashes, or lines, up to which they are sent to all executors; beyond, they are shuffled. 24 bytes each.
SENT = 1_000_000
#: Lines under one hash from which on they must share another segment to meet.
HOT = 256
#: Entries under one hash that a task compares, where there are more.
BLOCK = 1024
BLANK = " \t\r\x0b\x0c"


def line_array(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(BLANK)))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line_no, line, n of every line that isn't blank; n: its characters."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), line_array(F.col("text")).alias("lines"))
    return keyed.select("doc_id", "text_key", F.posexplode("lines").alias("line_no", "line")).where("line <> ''").withColumn("n", F.char_length("line"))


def segment(n: Column, i: int, parts: int) -> tuple[Column, Column]:
    """Place (from 1) and length of segment i (from 1) of a line of n characters; the last n % parts are one longer."""
    base, longer = F.floor(n / parts).cast("int"), (n % parts).cast("int")
    extra = F.greatest(F.lit(0), F.lit(i - 1 - parts) + longer)
    return F.lit(1) + F.lit(i - 1) * base + extra, base + F.when(longer >= parts - i + 1, 1).otherwise(0)


def slots(line: Column, n: Column, most: int) -> Iterator[tuple[Column, Column, Column]]:
    """Hash, place and length of what a line is entered under (the first most + 1) and of what it looks up. A lookup
    that would equal an entry of its own is left out: entries meet as well."""
    parts = most + 1
    asked = [(0, i, 0) for i in range(1, parts + 1)]
    for less in range(most + 1):
        for i in range(1, parts + 1):
            asked += [(less, i, shift) for shift in range(max(1 - i, less - (parts - i)), min(i - 1, less + parts - i) + 1) if less or shift]
    for less, i, shift in asked:
        at, size = segment(n - less, i, parts)
        at = at + F.lit(shift)
        yield F.xxhash64(n - less, F.lit(i), F.substring(line, at, size)), at, size


def tally(line: Column) -> Column:
    """How often each of LETTERS occurs, modulo 64, six bits for each, in one long."""
    counts = [F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(n.bitwiseAND(63).cast("long"), 6 * i) for i, n in enumerate(counts)])


def apart(x: Column, y: Column) -> Column:
    """By how much two tallies differ at least. An edit changes a tally by two at most."""
    out = []
    for i in range(len(LETTERS)):
        d = (F.shiftrightunsigned(x, 6 * i).bitwiseAND(63) - F.shiftrightunsigned(y, 6 * i).bitwiseAND(63)).bitwiseAND(63)
        out.append(F.least(d, F.lit(64) - d))
    return reduce(lambda x, y: x + y, out)


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def meet(members: DataFrame, most: int, whole: bool = False) -> DataFrame:
    """a < b: keys of lines that meet under one h, one of them entered there, and whose tallies aren't too far apart.
    members: h, key, tally, ask; with whole also line, and then pairs are compared here, so that only near ones leave
    the join. There a crowded h is dealt out: its entries in blocks, its lines to each of them."""
    index = members.where("not ask").select("h", F.col("key").alias("other"), F.col("tally").alias("theirs"), *[F.col("line").alias("other_line")] * whole)
    close = apart(F.col("tally"), F.col("theirs")) <= 2 * most
    on = ["h"]
    if whole:
        close = close & (F.levenshtein("line", "other_line", most) >= 0)
        crowds = few(members.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1"))
        block = F.coalesce(F.pmod(F.xxhash64("other"), "blocks"), F.lit(0).cast("long"))
        index = index.join(crowds, "h", "left").withColumn("block", block).drop("blocks")
        all_ = F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)
        members = members.join(crowds, "h", "left").withColumn("block", F.explode(all_)).drop("blocks")
        # few bytes, much work: tasks are dealt by keys and not put together by their size
        on, tasks = ["h", "block"], int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        index, members = index.repartition(tasks, *on), members.repartition(tasks, *on)
    same = reduce(lambda x, y: x & y, [members[c] == index[c] for c in on])
    pairs = members.join(index, same & (F.col("key") != F.col("other")) & (F.col("ask") | (F.col("key") < F.col("other"))) & close)
    return pairs.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b"))


def members_of(lines: DataFrame, line: str, n: str, most: int, *kept: str) -> DataFrame:
    """Each line's hashes with the place and length of what they stand for; kept: other columns."""
    found = [F.struct(h.alias("h"), F.lit(k > most).alias("ask"), at.alias("at"), size.alias("size")) for k, (h, at, size) in enumerate(slots(F.col(line), F.col(n), most))]
    return lines.select(*kept, F.inline(F.array(*found)))


def near_pairs(texts: DataFrame, shared: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """a < b: keys of near lines. texts: key, line, n, tally."""
    members = scratch.write("members", members_of(texts, "line", "n", most, "key", "tally").join(few(shared), "h"))
    counts = members.groupBy("h").agg(F.count(F.lit(1)).alias("lines"))
    hot = scratch.write("hot", counts.where(F.col("lines") > HOT).select("h"))
    cold = members.join(few(hot), "h", "left_anti")
    pairs = scratch.write("met", meet(cold, most).distinct())
    one = texts.select(F.col("key").alias("a"), F.col("line").alias("line_a"))
    two = texts.select(F.col("key").alias("b"), F.col("line").alias("line_b"))
    found = pairs.join(one, "a").join(two, "b").where(F.levenshtein("line_a", "line_b", most) >= 0).select("a", "b")
    if not hot.limit(1).count():
        return found
    # what is left of a line without the segment, under the hash of both
    left = members.join(few(hot), "h", "left_semi").join(texts.select("key", "line"), "key")
    left = left.select(F.col("h").alias("h1"), "key", "tally", "line", F.concat(F.expr("substring(line, 1, at - 1)"), F.expr("substring(line, at + size)")).alias("left"))
    left = members_of(left.withColumn("n", F.char_length("left")), "left", "n", most, "h1", "key", "tally", "line")
    left = scratch.write("left", left.select(F.xxhash64("h1", "h").alias("h"), "key", "tally", "ask", "line").distinct())
    return found.unionByName(meet(left, most, whole=True)).distinct()


def near(docs: DataFrame, lines: DataFrame, scratch: Scratch, most: int, shortest: int) -> DataFrame:
    """x, y: keys of near lines, each pair both ways. lines: id and hashes, of lines that are long enough."""
    each = lines.where("id is not null").select("id", F.posexplode("hashes").alias("slot", "h"))
    # hashes of different lines, one of which is entered there
    shared = each.groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min("slot").alias("slot"))
    shared = scratch.write("shared", shared.where((F.col("low") < F.col("high")) & (F.col("slot") <= most)).select("h"))
    needed = scratch.write("needed", each.join(few(shared), "h", "left_semi").select("id").distinct())
    texts = occurrences(docs).where(F.col("n") >= shortest).withColumn("id", F.xxhash64("line")).join(few(needed), "id", "left_semi")
    texts = texts.groupBy(F.unhex(F.md5("line")).alias("key")).agg(F.first("line").alias("line"))
    texts = scratch.write("texts", texts.select("key", "line", F.char_length("line").alias("n"), tally(F.col("line")).alias("tally")))
    found = scratch.write("pairs", near_pairs(texts, shared, scratch, most)).select(F.col("a").alias("x"), F.col("b").alias("y"))
    found = scratch.write("near", found.unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y"))))
    scratch.drop("shared", "needed", "texts", "members", "hot", "left", "met", "pairs")
    return found


def removals(docs: DataFrame, scratch: Scratch, most: int = 2, shortest: int = 20) -> DataFrame:
    """doc_id, text_key, removed array<int>, n_near, n_links: of each document that loses lines or has near ones: the
    numbers of its lost lines (from 0) in order, how many of them only have a near line before them, and the sum
    over its lines (each as often as it stands there) of how many different lines are near."""
    every = occurrences(docs)
    long = F.col("n") >= shortest
    hashes = F.array(*[h for h, _, _ in slots(F.col("line"), F.col("n"), most)])
    lines = scratch.write("lines", every.select("doc_id", "text_key", "line_no", F.unhex(F.md5("line")).alias("key"), F.when(long, F.xxhash64("line")).alias("id"), F.when(long, hashes).alias("hashes")))
    links = near(docs, lines, scratch, most, shortest)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "line_no")
    firsts = scratch.write("firsts", lines.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")))
    before = links.join(firsts.select(F.col("key").alias("y"), "first"), "y").groupBy(F.col("x").alias("key")).agg(F.min("first").alias("near"), F.count(F.lit(1)).alias("links"))
    # only lines with others that are equal or near go on
    marked = scratch.write("marked", firsts.join(before, "key", "left").where("n > 1 or near is not null").select("key", "first", "near", "links"))
    hit = lines.select("doc_id", "text_key", "line_no", "key", place.alias("place")).join(marked, "key")
    hit = hit.select("doc_id", "text_key", "line_no", "links", (F.col("first") < F.col("place")).alias("again"), F.coalesce(F.col("near") < F.col("place"), F.lit(False)).alias("close")).where("again or close or links > 0")
    out = hit.distinct().groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.expr("if(again or close, line_no, null)"))).alias("removed"),
        F.count_if(F.expr("close and not again")).alias("n_near"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
    )
    out = scratch.write("removals", out)
    scratch.drop("lines", "firsts", "near", "marked")
    return out


def report(docs: DataFrame, most: int = 2, shortest: int = 20) -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_removed, n_near, n_links, removed (the line numbers, comma-joined)."""
    lost = removals(docs, Scratch(docs.sparkSession), most, shortest).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.array_size(F.filter(line_array(F.col("text")), lambda x: x != "")).cast("long").alias("n_lines"))
    both = own.join(lost, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    none = F.lit(0).cast("long")
    counts = [F.coalesce(F.array_size("removed").cast("long"), none).alias("n_removed"), *[F.coalesce(c, none).alias(c) for c in ("n_near", "n_links")]]
    return both.select("doc_id", "n_lines", *counts, F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def dedup(docs: DataFrame, most: int = 2, shortest: int = 20) -> DataFrame:
    """docs without the removed lines; a document that had lines and lost all of them goes."""
    lost = removals(docs, Scratch(docs.sparkSession), most, shortest)
    # the row's own columns stay in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("row_id"), text_key(F.col("text")).alias("row_key"))
    both = rows.join(lost.where(F.array_size("removed") > 0), (F.col("row_key") == F.col("text_key")) & F.col("row_id").eqNullSafe(F.col("doc_id")), "left")
    parts = F.split(F.col("row")["text"], "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.array_size(parts) - 1), F.col("removed"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    out = both.select("row", "removed", F.when(F.col("removed").isNull(), F.col("row")["text"]).otherwise(kept).alias("kept"))
    out = out.where(F.col("removed").isNull() | (F.trim("kept", F.lit(BLANK + "\n")) != ""))
    return out.select(*[F.col("kept").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
