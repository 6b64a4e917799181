"""Near-duplicates by SimHash, linked with a hierarchical index in Gray order.

Fingerprints: words are runs other than ASCII white space, A-Z lower-cased; a bit is set if it is set in more than
half of the hashes (XXH64, seed 42) of a text's word shingles, repeats included. Texts of fewer words than a shingle
are one shingle, texts without words have fingerprint zero.

Index: two fingerprints that differ in at most d bits share at least one of d + 1 masks (bands of bits that lie side by
side), so each fingerprint hangs below one upper node for each mask: the node of its bits there. Below an upper node
fingerprints are sorted by Gray rank, with the mask's bits foremost; those with equal leading bits form the nodes of
further levels. Pairs of nodes go down together: differences of the shared bits add up level by level, and a pair with
more than d, or whose members are linked already, is dropped whole. A task gives the links of a spanning forest only.

Equal fingerprints are brought together before; null texts count as empty; null doc_ids belong to classes but never
name one. Results don't depend on the order of rows. Repeated rows give repeated results. Very long texts are taken
whole. An empty table gives nothing. Columns other than doc_id and text are ignored by near_duplicates() and kept by dedup().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import jaccard
from tidemill.llm.common import Scratch
from tidemill.llm.components import components
from tidemill.llm.lines import text_key
from tidemill.llm.shingles import LOWER, Forest, expand

#: Pairs of nodes or fingerprints that are compared at a time.
AT_ONCE = 1 << 21
#: Leading bits that the nodes of each level share.
LEVELS = (24, 32, 44, 64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """As an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        flat = b" ".join(words)
        stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.r_[0, stop[:-1] + 1][: len(words) - size + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], 42) for a, b in zip(start.tolist(), stop[size - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), size) for t in b.column("text")), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def links(values: np.ndarray, lead: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """values: distinct fingerprints, with the mask's bits foremost, in Gray order. Those with equal `lead` leading
    bits are compared. Returns for each the least place in its class, and the least place that it differs from in at
    most `most` bits among those that were compared (n if none)."""
    n = len(values)
    forest = Forest(n)
    if n < 2:
        return forest.label, forest.partner
    prefix = lambda bits: values >> np.uint64(64 - bits)
    near = np.flatnonzero((prefix(lead)[1:] == prefix(lead)[:-1]) & (np.bitwise_count(values[1:] ^ values[:-1]) <= most))
    forest.link(near, near + 1)  # Gray neighbours first: most of a dense group is one class from then on
    starts = {bits: np.flatnonzero(np.r_[True, prefix(bits)[1:] != prefix(bits)[:-1]]) for bits in (lead, *[x for x in LEVELS if x > lead])}
    levels = list(starts)
    child = {}  # of each node of a level: its first child and their number, in the next
    for up, down in zip(levels, levels[1:]):
        at = np.searchsorted(starts[down], np.r_[starts[up], n])
        child[up] = at[:-1], np.diff(at)
    size = np.diff(np.r_[starts[lead], n])
    roots = np.flatnonzero(size > 1)

    def single(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether all members of both nodes of a pair are linked already."""
        low = np.minimum.reduceat(forest.label, starts[level])
        high = np.maximum.reduceat(forest.label, starts[level])
        return np.minimum(low[a], low[b]) == np.maximum(high[a], high[b])

    work = [(0, roots, roots)]
    while work:
        k, a, b = work.pop()
        level = levels[k]
        if level == 64:
            far = np.bitwise_count(values[a] ^ values[b]) <= most
            forest.link(a[far], b[far])
            continue
        keep = ~single(level, a, b)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        first, count = child[level]
        pairs = count[a] * count[b]
        if len(a) > 1 and pairs.sum() > AT_ONCE:
            half = len(a) // 2
            work += [(k, a[half:], b[half:]), (k, a[:half], b[:half])]
            continue
        down = levels[k + 1]
        nodes = values[starts[down]] >> np.uint64(64 - down)
        if len(a) == 1 and pairs[0] > AT_ONCE:  # a wide node: line by line
            rows = max(1, AT_ONCE // int(count[b[0]]))
            left = first[a[0]] + np.arange(count[a[0]])
            blocks = [left[i : i + rows] for i in range(0, len(left), rows)]
            right = first[b[0]] + np.arange(count[b[0]])
            grid = ((np.repeat(x, len(right)), np.tile(right, len(x))) for x in blocks)
        else:
            owner, x = expand(first[a], count[a])
            again, y = expand(first[b][owner], count[b][owner])
            grid = ((x[again], y),)
        for x, y in grid:
            ok = (np.bitwise_count(nodes[x] ^ nodes[y]) <= most) & (x <= y if down < 64 else x < y)
            x, y = x[ok], y[ok]
            if down < 64:
                work.append((k + 1, x, y))
            else:
                forest.link(x, y)
    return forest.label, forest.partner


def near_pairs(distinct: DataFrame, most: int = 3) -> DataFrame:
    """distinct: k, fp, each pair once; only fingerprints with equal k are compared. Edges k, u, v whose components are
    those of the links of at most `most` differing bits. Fingerprints go to the tasks by k, mask and pattern: most + 1
    rows for each."""
    bands = most + 1
    width = 64 // bands

    def run(batches):
        held: dict[tuple[int, int], list] = {}
        for b in batches:
            k, fp, band = (b.column(c).to_numpy() for c in ("k", "fp", "band"))
            for lot in {*zip(k.tolist(), band.tolist())}:
                held.setdefault(lot, []).append(fp.view(np.uint64)[(k == lot[0]) & (band == lot[1])])
        for k, band in sorted(held):
            x = np.concatenate(held.pop((k, band)))
            turn, rest = np.uint64(band * width), np.uint64(64 - band * width)
            if band:
                x = (x << turn) | (x >> rest)
            x = x[np.argsort(gray_rank(x), kind="stable")]
            to = links(x, width, most)[0]
            if band:
                x = (x << rest) | (x >> turn)
            own = np.flatnonzero(to != np.arange(len(x)))
            for i in range(0, len(own), 1 << 16):
                part = own[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), pa.array(x[part].view(np.int64)), pa.array(x[to[part]].view(np.int64))], names=["k", "u", "v"])

    hung = distinct.select(F.col("k").cast("int").alias("k"), "fp", F.explode(F.array(*[F.lit(b) for b in range(bands)])).alias("band"))
    pattern = F.expr(f"shiftrightunsigned(shiftleft(fp, band * {width}), {64 - width})")
    return hung.select("k", "fp", "band", pattern.alias("pattern")).repartition("k", "band", "pattern").mapInArrow(run, "k int, u long, v long")


def classes(docs: DataFrame, scratch: Scratch, size: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fp, component_id for each row of docs: component_id is the smallest doc_id that links lead to."""
    prints = scratch.write("prints", fingerprints(docs, size))
    first = scratch.write("first", prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    found = components(near_pairs(first.select(F.lit(0).alias("k"), "fp"), most), scratch).withColumnRenamed("node", "fp")
    named = first.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = scratch.write("named", named.join(least, "component").select("fp", "component_id"))
    scratch.drop("first", "components")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    out = classes(docs, Scratch(docs.sparkSession))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Removing near copies


def hints(texts: DataFrame, most: int) -> DataFrame:
    """u, v: tids of texts whose fingerprints the index links, or that have one fingerprint. texts: tid, mark."""
    heads = texts.groupBy("mark").agg(F.min("tid").alias("head"))
    found = near_pairs(heads.select(F.lit(0).alias("k"), F.col("mark").alias("fp")), most)
    a, b = (heads.select(F.col("mark").alias(x), F.col("head").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    found = found.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return found.unionByName(texts.join(heads, "mark").where("tid <> head").select(F.col("head").alias("u"), F.col("tid").alias("v")))


def dedup(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5), most: int = 3) -> DataFrame:
    """docs without near copies: of each group the row with the smallest doc_id stays (null ids come last; of rows with
    equal id and text the one whose other columns sort first as JSON). Texts are linked if their sets of `size`-word
    shingles have a Jaccard similarity of at least similarity = num / den; texts without words are copies of each
    other. All columns are kept, whatever their names.

    The index in Gray order finds texts whose fingerprints differ in at most `most` bits. Each pair that it gives is compared by
    its shingles and links only if these are similar: texts that repeat one phrase have like fingerprints, whatever
    else they hold. The classes of these links are settled; the join by leading shingles that follows (see jaccard) is for
    the links that are left, so nothing is lost behind a pair that is refused or that the index can't find."""
    scratch = Scratch(docs.sparkSession)
    rows = jaccard.classes(docs, scratch, size, similarity, fingerprint, lambda texts: hints(texts, most))
    rows = scratch.write("classes", rows.select("doc_id", "key", F.coalesce("class", F.lit(-1).cast("long")).alias("class")))
    scratch.drop("rows", "named")
    own = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    best = rows.groupBy("class").agg(F.min(own).alias("best"), F.max(own).alias("other")).where("best <> other").select("class", "best")
    lost = scratch.write("lost", rows.join(jaccard.few(best), "class").where(own != F.col("best")).select("doc_id", "key").distinct())
    again = scratch.write("again", rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "key"))
    scratch.drop("classes")
    # the row's own columns stay in a struct, so that no name of theirs meets one of ours
    out = docs.select(F.struct("*").alias("row"), text_key(F.col("text")).alias("text_key"), F.col("doc_id").cast("long").alias("doc"))
    among = lambda table: (F.col("text_key") == table["key"]) & F.col("doc").eqNullSafe(table["doc_id"])
    out = out.join(jaccard.few(lost), among(lost), "left_anti")
    if again.limit(1).count():
        several = out.join(jaccard.few(again), among(again), "left_semi")
        several = several.groupBy("text_key", "doc").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.join(jaccard.few(again), among(again), "left_anti").select("row").unionByName(several.select("row"))
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns])
