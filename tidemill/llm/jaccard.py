"""Joins on the Jaccard similarity of word shingles, by signature trees.

Words are runs other than ASCII white space, A-Z lower-cased. A text's set holds its distinct shingles of `size` words;
of a text with fewer words the one of all of them; without words it is empty and linked with nothing. Two texts are linked if the
intersection of their sets is at least similarity = num / den of their union.

1. Texts with equal sets are one. In an order of all shingles, common ones last, two similar sets share k of the first
   n - ceil(similarity * n) + k shingles of each (k = `AGREE`, or less for very small sets): their leading shingles.
2. Where few texts have a leading shingle, pairs are listed whose sizes, and whose places of it, allow the similarity;
   those that share k of them are candidates. Where more have it, each is a candidate with the one of smallest number.
3. Classes of the candidates are lots, each of which is joined. Those that crowded shingles have brought together are one lot if
   that is less work than a lot for each such shingle. Large lots are cut in blocks by size, and each pair of blocks
   of like sizes is a unit of its own, so no group meets in one task.

A join takes the sets of two blocks, or of one with itself. It hangs them, sorted by size and first shingle, below
trees whose nodes hold the OR of the bitmaps below them (a bit for each shingle's hash), their smallest and largest
size, and their slack: by how much a set has more shingles than bits, at most. Two sets share at most as many shingles as the bits that
both nodes have plus the lesser slack; node pairs whose bound is below what the similarity asks of their smallest sets, or whose sizes are
too far apart, or whose members are linked already, are dropped whole. What is left at the leaves is counted exactly.
Tasks emit a spanning forest of the links, so no class is written out as pairs, and no link between classes is lost.

Null texts are empty. Null doc_ids belong to classes but never name one. Repeated rows give repeated results. Very long texts are
taken whole. An empty table gives nothing. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, trim
from tidemill.llm.components import components
from tidemill.llm.lines import text_key
from tidemill.llm.shingles import Forest, common_shingles, expand, shingle_set, words_of

#: Leading shingles that candidates share.
AGREE = 3
#: Texts that share a shingle up to which their pairs are listed.
LISTED = 128
#: Texts in a block.
BLOCK = 512
#: Nodes below a node, and pairs of nodes that are compared at a time.
FAN, AT_ONCE = 8, 1 << 17
#: Up to so many rows a table of keys is sent to all executors, some 60 bytes each there. Beyond, it is shuffled.
SENT = 100_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, ascending; none without words."""
    return shingle_set(text, size) if words_of(text) else np.zeros(0, "<u8")


def leading(found: np.ndarray, common: np.ndarray, similarity: tuple[int, int], agree: int | None = None) -> np.ndarray:
    """The first shingles of a set in the order of all tasks."""
    num, den = similarity
    least = -(num * len(found) // -den)  # shingles that a similar set shares with it
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        hot = common[at] == found
        found = np.concatenate([found[~hot], found[hot]])
    return found[: len(found) - least + min(agree or AGREE, least)]


class SignatureTree:
    """Of the sets at some places, sorted by size and first shingle."""

    def __init__(self, sets: list[np.ndarray], places: np.ndarray, bits: int):
        size = np.array([len(sets[p]) for p in places.tolist()], np.int64)
        first = np.array([sets[p][0] for p in places.tolist()], np.uint64)
        order = np.lexsort((first, size))
        self.places = places[order]
        map_ = np.zeros((len(places), bits), np.uint8)
        for row, p in enumerate(self.places.tolist()):
            map_[row, (sets[p] & np.uint64(bits - 1)).astype(np.int64)] = 1
        packed = np.packbits(map_, axis=1).view(np.uint64)
        slack = size[order] - map_.sum(1, dtype=np.int64)
        #: From the leaves up: bitmaps, smallest and largest size, slack, and the first leaf of each node.
        self.levels = [(packed, size[order], size[order], slack, np.arange(len(places)))]
        while len(packed) > FAN:
            packed, low, high, slack, leaf = self.levels[-1]
            cut = np.arange(0, len(packed), FAN)
            packed = np.bitwise_or.reduceat(packed, cut, axis=0)
            self.levels.append((packed, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut), leaf[cut]))

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes of a level over the leaves'."""
        first = node * FAN
        return first, np.minimum(first + FAN, len(self.levels[level - 1][1])) - first


def join(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: tuple[int, int], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places that bring together the classes of the links between left and right (or within left, if both are
    the same). No set is empty. Places with equal known are linked before."""
    num, den = similarity
    forest = Forest(len(sets))
    if known is not None:
        first, at = np.unique(known, return_index=True, return_inverse=True)[1:]
        forest.link(np.arange(len(sets)), first[at])
    label = forest.label
    bits = 1 << min(16, max(9, int(4 * max(map(len, sets)) - 1).bit_length()))
    same = left is right
    one = SignatureTree(sets, left, bits)
    two = one if same else SignatureTree(sets, right, bits)
    size = np.array([len(x) for x in sets], np.int64)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start, mark = np.cumsum(size) - size, np.zeros(int(column.max()) + 1, np.int64)

    def verify(x: np.ndarray, y: np.ndarray) -> None:
        """x ascending."""
        cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(x)]):
            i, other = x[a], y[a:z]
            other = other[label[other] != label[i]]
            if not len(other):
                continue
            own = column[start[i] : start[i] + size[i]]
            mark[own] = 1
            at = expand(start[other], size[other])[1]
            both = np.add.reduceat(mark[column[at]], np.cumsum(size[other]) - size[other])
            mark[own] = 0
            hit = other[den * both >= num * (size[i] + size[other] - both)]
            if len(hit):
                forest.link(np.full(len(hit), i), hit)

    top = max(len(one.levels), len(two.levels)) - 1
    level_of = lambda tree, k: min(k, len(tree.levels) - 1)
    x, y = (g.ravel() for g in np.meshgrid(*(np.arange(len(t.levels[-1][1])) for t in (one, two)), indexing="ij"))
    work = [(top, x, y)]
    while work:
        k, x, y = work.pop()
        if len(x) > AT_ONCE // FAN:
            half = len(x) // 2
            work += [(k, x[half:], y[half:]), (k, x[:half], y[:half])]
            continue
        i, j = level_of(one, k), level_of(two, k)
        if same:
            keep = x <= y if k else x < y
            x, y = x[keep], y[keep]
        p, low_p, high_p, slack_p, leaf_p = one.levels[i]
        q, low_q, high_q, slack_q, leaf_q = two.levels[j]
        fits = (den * high_p[x] >= num * low_q[y]) & (den * high_q[y] >= num * low_p[x])
        x, y = x[fits], y[fits]
        if k and len(x):
            bound = [(f.reduceat(label[t.places], leaf)) for t, leaf in ((one, leaf_p), (two, leaf_q)) for f in (np.minimum, np.maximum)]
            apart = np.minimum(bound[0][x], bound[2][y]) < np.maximum(bound[1][x], bound[3][y])
        else:
            apart = label[one.places[x]] != label[two.places[y]]
        x, y = x[apart], y[apart]
        shared = np.bitwise_count(p[x] & q[y]).sum(1, dtype=np.int64) + np.minimum(slack_p[x], slack_q[y])
        shared = np.minimum(shared, np.minimum(high_p[x], high_q[y]))
        near = (num + den) * shared >= num * (low_p[x] + low_q[y])
        x, y = x[near], y[near]
        if not len(x):
            continue
        if not k:
            order = np.lexsort((y, x))
            verify(one.places[x[order]], two.places[y[order]])
            continue
        # the tree that is less high waits
        first, count = one.children(i, x) if i == k else (x, np.ones_like(x))
        owner, below = expand(first, count)
        again, across = expand(*((v[owner] for v in two.children(j, y)) if j == k else (y[owner], np.ones_like(owner))))
        work.append((k - 1, below[again], across))
    below = np.flatnonzero(label != np.arange(len(sets)) if known is None else known[label] != known)
    return list(zip(below.tolist(), label[below].tolist()))


def _join_units(placed: DataFrame, unit: list[str], similarity: tuple[int, int]) -> DataFrame:
    """Edges u, v of the joins, but those within a class that is known. placed: the columns of unit, tid, shingles, side
    (0: left, 1: right, 2: both), known (equal for texts that are linked before)."""

    def units(batches):
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                key = tuple(r[c] for c in unit)
                if key != now:
                    yield rows
                    now, rows = key, []
                rows.append(r)
        yield rows

    def run(batches):
        for rows in units(batches):
            side = np.array([r["side"] for r in rows])
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            known = np.array([r["known"] for r in rows], np.int64)
            if not len(left) or not len(right) or (known == known[0]).all():
                continue
            sets = [np.frombuffer(r["shingles"], "<u8") for r in rows]
            pairs = join(sets, left, left if (side == 2).all() else right, similarity, known)
            if pairs:
                u, v = ([rows[p[k]]["tid"] for p in pairs] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        trim()

    dealt = placed.select(*unit, "tid", "shingles", "side", "known").repartition(*unit).sortWithinPartitions(*unit)
    return dealt.mapInArrow(run, "u long, v long")


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SENT else df


def classes(
    docs: DataFrame,
    scratch: Scratch,
    size: int = 5,
    similarity: tuple[int, int] = (4, 5),
    mark: Callable[[str | None], int] | None = None,
    hinted: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """For each row of docs: doc_id, key (of the text), n (size of its set), class (a number for texts that links bring
    together; null if the set is empty), first (the smallest doc_id of the class).

    hinted: gives pairs u, v of tids, of a table of tid and mark (mark of a text, as an unsigned number, read as a long).
    These are compared first. The classes that their links make are settled: the join that follows leaves lots of one class out and
    compares no two texts of a class, so it is for the links that no hint leads to."""
    common = common_shingles(docs, size)

    def scan(batches):
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column("text")]
            marks = np.array([mark(t.as_py()) if mark else 0 for t in b.column("text")], np.uint64).view(np.int64)
            columns = [pa.array([hashlib.md5(x.tobytes()).digest() if len(x) else None for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([leading(x, common, similarity).tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), *columns, pa.array(marks)], names=["doc_id", "key", "set", "n", "lead", "mark"])
        trim()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("key"))
    rows = scratch.write("rows", keyed.mapInArrow(scan, "doc_id long, key binary, set binary, n long, lead binary, mark long"))
    texts = rows.where("n > 0").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("least"), F.first("n").alias("n"), F.first("lead").alias("lead"), F.min("mark").alias("mark"))
    texts = scratch.write("texts", texts.withColumn("tid", F.monotonically_increasing_id()))

    def spread(batches):
        for b in batches:
            lead = [np.frombuffer(x.as_py(), "<i8") for x in b.column("lead")]
            count = np.array([len(x) for x in lead], np.int64)
            if len(count):
                tid, n = (np.repeat(b.column(c).to_numpy(), count) for c in ("tid", "n"))
                rest = n - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                flat = np.concatenate(lead)
                for i in range(0, len(flat), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in (flat, tid, n, rest)], names=["h", "tid", "n", "rest"])

    num, den = similarity

    def like(n, m, rest):
        """Whether sets of n and m shingles may be similar that meet under one of the first shingles that they share, from
        which on one of them has `rest` left: they would share (n + m) * num / (num + den), all but AGREE - 1 of them from here on."""
        return (den * F.least(n, m) >= num * F.greatest(n, m)) & ((rest + AGREE - 1) * (num + den) >= num * (n + m))

    each = scratch.write("each", texts.select("tid", "n", "lead").mapInArrow(spread, "h long, tid long, n long, rest long"))
    texts = scratch.write("slim", texts.select("tid", "set", "least", "n", "mark"))
    scratch.drop("texts")
    crowd = each.groupBy("h").agg(F.count(F.lit(1)).alias("members"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("rest").alias("least"))
    two = (F.col("members") > 2) | like(F.col("low"), F.col("high"), F.col("least"))
    crowd = scratch.write("crowd", crowd.where((F.col("members") > 1) & two).select("h", "members"))
    met = scratch.write("met", each.join(few(crowd), "h"))
    scratch.drop("each", "crowd")

    few_share = met.where(F.col("members") <= LISTED)
    other = few_share.select("h", F.col("tid").alias("v"), F.col("n").alias("m"), F.col("rest").alias("left"))
    enough = F.least(F.lit(AGREE), F.ceil(F.least("n", "m") * num / den))
    pairs = few_share.select("h", F.col("tid").alias("u"), "n", "rest").join(other, "h").where((F.col("u") < F.col("v")) & like(F.col("n"), F.col("m"), F.least("rest", "left")))
    pairs = pairs.groupBy("u", "v").agg(F.count(F.lit(1)).alias("k"), F.min(enough).alias("enough")).where("k >= enough").select("u", "v")
    inner = Scratch(docs.sparkSession)
    group = components(scratch.write("pairs", pairs), inner).withColumnRenamed("node", "tid").withColumnRenamed("component", "grp")
    # similar sets are of one class of sizes or of two that follow each other
    step = math.log(den / num) * 1.001 if num < den else 1e-9
    size_class = F.floor(F.log(F.col("n").cast("double")) / step).cast("long")
    many = met.where(F.col("members") > LISTED).select("h", "tid", size_class.alias("cls"))
    beside = many.groupBy("h", "cls").agg(F.count(F.lit(1)).alias("m"))
    beside = beside.select("h", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1)).alias("cls"), "m").groupBy("h", "cls").agg(F.sum("m").alias("m")).where("m > 1").select("h", "cls")
    many = scratch.write("many", many.join(beside, ["h", "cls"]).select("h", "tid"))
    scratch.drop("met", "pairs")
    lots = group.select(F.lit(0).alias("kind"), F.col("grp").alias("lot"), "tid")
    if many.limit(1).count():
        outer = Scratch(docs.sparkSession)
        ends = many.join(few(many.groupBy("h").agg(F.min("tid").alias("head"))), "h").join(group, "tid", "left").withColumn("grp", F.coalesce("grp", "tid"))
        heads = group.select(F.col("tid").alias("head"), F.col("grp").alias("top"))
        ends = scratch.write("ends", ends.join(heads, "head", "left").select("h", "tid", "grp", F.coalesce("top", "head").alias("top")))
        cluster = components(ends.select(F.col("top").alias("u"), F.col("grp").alias("v")), outer).withColumnRenamed("node", "grp").withColumnRenamed("component", "cluster")
        # a cluster is joined at once if that is less work than to do it for each of its shingles and each class of candidates
        every = group.unionByName(ends.select("tid", "grp")).distinct()
        sizes = every.groupBy("grp").agg(F.count(F.lit(1)).alias("m")).join(cluster, "grp")
        single = ends.groupBy("h", "top").agg(F.count(F.lit(1)).alias("m")).join(cluster.withColumnRenamed("grp", "top"), "top")
        work = single.groupBy("cluster").agg(F.sum(F.col("m") * F.col("m")).alias("apart")).join(sizes.groupBy("cluster").agg(F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("before")), "cluster")
        whole = scratch.write("whole", cluster.join(work.where("all * all <= apart + before").select("cluster"), "cluster"))
        lots = scratch.write("lots", lots.join(whole.select(F.col("grp").alias("lot")), "lot", "left_anti")
            .unionByName(every.join(whole, "grp").select(F.lit(1).alias("kind"), F.col("cluster").alias("lot"), "tid"))
            .unionByName(ends.join(whole.select(F.col("grp").alias("top")), "top", "left_anti").select(F.lit(2).alias("kind"), F.col("h").alias("lot"), "tid")))
        outer.drop("components")
    placed = lots.join(texts.select("tid", size_class.alias("cls")), "tid")
    crowds = lots.groupBy("kind", "lot").agg(F.count(F.lit(1)).alias("all"))
    placed = scratch.write("placed", placed.join(crowds, ["kind", "lot"]).where("all > 1"))
    inner.drop("components")
    scratch.drop("many", "ends", "whole", "lots")

    def sets_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array([shingles(t.as_py(), size).tobytes() for t in b.column("text")], pa.binary())], names=["tid", "shingles"])
        trim()

    # one row for each text: that of the least id; of repeated rows any
    wanted = placed.select("tid")
    if hinted:
        hints = scratch.write("hints", hinted(texts.select("tid", "mark")).select("u", "v").where("u <> v").distinct())
        wanted = wanted.unionByName(hints.select(F.col("u").alias("tid"))).unionByName(hints.select(F.col("v").alias("tid")))
    need = few(wanted.distinct().join(texts.select("tid", "least"), "tid").select("tid", F.col("least.key").alias("need"), F.col("least.doc_id").alias("own")))
    chosen = keyed.join(need, F.col("key") == F.col("need")).where(F.col("doc_id").eqNullSafe(F.col("own"))).select("tid", "text")
    sets = scratch.write("sets", chosen.mapInArrow(sets_of, "tid long, shingles binary"))
    if (several := sets.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")).limit(1).count():
        repeated = sets.join(few(several.select("tid")), "tid", "left_semi").groupBy("tid").agg(F.first("shingles").alias("shingles"))
        sets = scratch.write("single", sets.join(few(several.select("tid")), "tid", "left_anti").unionByName(repeated))

    placed, linked = placed.withColumn("known", F.col("tid")), None
    if hinted:
        parts = hints.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        dealt = hints.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), "parts").alias("part"), "v")
        ends = dealt.select("u", "part", F.col("u").alias("tid"), F.lit(0).alias("side")).distinct().unionByName(dealt.select("u", "part", F.col("v").alias("tid"), F.lit(1).alias("side")))
        ends = sets.join(few(ends), "tid").withColumn("known", F.col("tid"))
        linked = scratch.write("linked", _join_units(ends, ["u", "part"], similarity))
        settled = components(linked, inner).withColumnRenamed("node", "tid")
        placed = placed.join(few(settled), "tid", "left").withColumn("known", F.coalesce("component", "tid")).drop("component")
        open_ = placed.groupBy("kind", "lot").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low < high").select("kind", "lot")
        placed = scratch.write("open", placed.join(open_, ["kind", "lot"]))
        inner.drop("components")
        scratch.drop("hints")

    zero = F.lit(0).cast("long")
    small = placed.where(F.col("all") <= BLOCK).select("kind", "lot", *[zero.alias(c) for c in ("ci", "bi", "cj", "bj")], "tid", F.lit(2).alias("side"), "known")
    large = placed.where(F.col("all") > BLOCK).select("kind", "lot", "tid", "cls", "known")
    blocks = large.groupBy("kind", "lot", "cls").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = large.join(blocks, ["kind", "lot", "cls"]).withColumn("own", F.struct(F.col("cls").alias("c"), F.pmod(F.xxhash64("tid"), "blocks").alias("b"))).drop("blocks")
    near = own.withColumn("cls", F.explode(F.array(F.col("cls") - 1, F.col("cls"), F.col("cls") + 1))).join(blocks, ["kind", "lot", "cls"])
    near = near.withColumn("b", F.explode(F.sequence(zero, F.col("blocks") - 1))).withColumn("with", F.struct(F.col("cls").alias("c"), "b"))
    i, j = F.least("own", "with"), F.greatest("own", "with")
    side = F.when(F.col("own") == F.col("with"), 2).when(F.col("own") == i, 0).otherwise(1)
    large = near.select("kind", "lot", i["c"].alias("ci"), i["b"].alias("bi"), j["c"].alias("cj"), j["b"].alias("bj"), "tid", side.alias("side"), "known")
    units = sets.join(few(small.unionByName(large)), "tid")
    edges = scratch.write("edges", _join_units(units, ["kind", "lot", "ci", "bi", "cj", "bj"], similarity))
    group = components(edges.unionByName(linked) if linked else edges, scratch).withColumnRenamed("node", "tid")
    named = texts.select("set", "tid", F.col("least.doc_id").alias("own")).join(group, "tid", "left").select("set", F.coalesce("component", "tid").alias("class"), "own")
    heads = named.groupBy("class").agg(F.min("own").alias("first"))
    named = scratch.write("named", named.join(heads, "class").select("set", "class", "first"))
    scratch.drop("slim", "sets", "single", "edges", "placed", "linked", "open", "components")
    return rows.select("doc_id", "key", "set", "n").join(named, "set", "left").select("doc_id", "key", "n", "class", "first")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5)) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id: the smallest doc_id that links lead to, or its own."""
    found = classes(docs, Scratch(docs.sparkSession), size, similarity)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))
