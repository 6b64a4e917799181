"""Runs: stretches of words that repeat with a period, and texts without the repeats.

Words are runs other than ASCII white space, numbered from 0. A run is a stretch with smallest period q (words q apart
are equal) and at least max(shortest, 2 * q) words that no neighbouring word extends keeping period q.

Every run has a Lyndon word as its root in one of the two orders of the alphabet, and that is the longest Lyndon word
that starts at its place: it ends where the next smaller (or, in the other order, the next larger) suffix starts. So
each place gives two candidates. How far a candidate's period goes on to the right is the longest common prefix of two
suffixes: the depth of the lowest common ancestor of two leaves in the suffix tree (Ukkonen), the least depth between
them in the tree's Euler tour, which blocks with a sparse table give in constant time. To the left the tree of the reversed words does
the same. The leaves' order also gives the suffixes' order.

Only stretches in which runs can lie get trees: with m half of the least length, the words of a run without its last
period stand again a period later, and are m or more. So each word of a run is covered by m words in a row that stand
at another place, too; what such places cover without a gap is a stretch, and this is asked again within each. Hashes find them,
which may only mark too many.

Null and blank texts have no runs. Null doc_ids are kept. Rows don't depend on each other: repeated rows give repeated
results, an empty table none. Long texts are taken whole, in one task, with memory in proportion to their longest
stretch. Columns other than doc_id and text are ignored by report() and find(), and kept by collapse(), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import sha, trim

#: Places of an Euler tour that are looked through one by one.
BLOCK = 16
#: How often stretches are asked for again within stretches.
ROUNDS = 4
NONE = np.zeros((0, 3), np.int64)


class SuffixTree:
    """Of numbers over zero, to which a zero is added at the end."""

    def __init__(self, word: list[int]):
        self.size = len(word)
        self._tour(*self._grow([*word, 0]))

    @staticmethod
    def _grow(s: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
        """Ukkonen's construction: first places and ends of the edges to each node, and the nodes below each node by
        the first number of their edge (key: node * width + number)."""
        n, width = len(s), max(s) + 1
        first, end, link, below = [0], [0], [0], {}
        node = edge = length = rest = 0  # the active point, and how many suffixes are still to be added
        for i, c in enumerate(s):
            rest += 1
            open_ = 0  # an inner node that waits for its suffix link
            while rest:
                if not length:
                    edge = i
                key = node * width + s[edge]
                to = below.get(key)
                if to is None:
                    below[key] = len(first)
                    first.append(i)
                    end.append(n)
                    link.append(0)
                    if open_:
                        link[open_] = node
                        open_ = 0
                else:
                    size = end[to] - first[to]
                    if length >= size:
                        node, edge, length = to, edge + size, length - size
                        continue
                    at = first[to] + length
                    if s[at] == c:
                        length += 1
                        if open_:
                            link[open_] = node
                        break
                    inner = len(first)
                    below[key] = inner
                    below[inner * width + c] = inner + 1
                    below[inner * width + s[at]] = to
                    first += (first[to], i)
                    end += (at, n)
                    link += (0, 0)
                    first[to] = at
                    if open_:
                        link[open_] = inner
                    open_ = inner
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        return first, end, below, width

    def _tour(self, first: list[int], end: list[int], below: dict[int, int], width: int) -> None:
        """Depths along the Euler tour, children in order; place and rank of each suffix's leaf."""
        keys = np.fromiter(below, np.int64, len(below))
        order = np.argsort(keys)
        nodes = np.fromiter(below.values(), np.int64, len(below))[order][::-1].tolist()  # the last child first, for the stack
        starts = len(nodes) - np.searchsorted(keys[order], np.arange(len(first) + 1) * width)
        starts = starts.tolist()
        depth, tour, leaves, place = [0] * len(first), [], [], []
        stack = [0]
        while stack:
            x = stack.pop()
            if x < 0:
                tour.append(depth[~x])
                continue
            deep = depth[x]
            a, z = starts[x + 1], starts[x]
            if a == z:
                leaves.append(deep)
                place.append(len(tour))
            else:
                for child in nodes[a:z]:
                    depth[child] = deep + end[child] - first[child]
                    stack += (~x, child)
            tour.append(deep)
        suffix = self.size + 1 - np.array(leaves)
        self.place, self.rank = np.zeros(self.size + 1, np.int64), np.zeros(self.size + 1, np.int64)
        self.place[suffix], self.rank[suffix] = place, np.arange(len(place))
        padded = np.full(-(-len(tour) // BLOCK) * BLOCK, self.size + 1, np.int64)
        padded[: len(tour)] = tour
        blocks = padded.reshape(-1, BLOCK)
        self.depth = padded
        self.up_to = np.minimum.accumulate(blocks, axis=1).ravel()
        self.on = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while (step := 1 << (len(self.table) - 1)) * 2 <= len(blocks):
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes from a and b on have in common, a <> b."""
        x, y = self.place[a], self.place[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        i, j = x // BLOCK, y // BLOCK
        out = np.minimum(self.on[x], self.up_to[y])
        same = np.flatnonzero(i == j)
        if len(same):
            at = np.minimum(x[same, None] + np.arange(BLOCK), y[same, None])
            out[same] = self.depth[at].min(axis=1)
        far = np.flatnonzero(j - i > 1)
        if len(far):
            lo, hi = i[far] + 1, j[far]  # whole blocks between
            level = np.frexp(hi - lo)[1] - 1
            for k in np.unique(level).tolist():
                some = level == k
                t = self.table[k]
                out[far[some]] = np.minimum(out[far[some]], np.minimum(t[lo[some]], t[hi[some] - (1 << k)]))
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller value; the number of places if there is none."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_in(word: np.ndarray, shortest: int) -> np.ndarray:
    """start, length, period of the runs of a word of numbers from zero, each once."""
    n = len(word)
    if n < max(shortest, 2):
        return NONE
    tree = SuffixTree((word + 1).tolist())
    rank = tree.rank[:n]
    at = np.tile(np.arange(n), 2)
    to = np.array(next_smaller(rank.tolist()) + next_smaller((-rank).tolist()))
    inner = (np.arange(2 * n) < n) | (to < n)  # the end is smaller than any word; in the other order it is larger, and ends no Lyndon word
    at, to = at[inner], to[inner]
    right = tree.common(at, to)
    del tree
    back = SuffixTree((word[::-1] + 1).tolist())
    left = back.common(n - at, n - to)
    period = to - at
    found = np.stack([at - left, left + period + right, period], axis=1)
    found = found[found[:, 1] >= np.maximum(shortest, 2 * period)]
    return np.unique(found, axis=0) if len(found) else NONE


def stretches(word: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """First place and end of what can hold runs: any run is whole in one of them."""
    m = (shortest + 1) // 2
    out, work = [], [(0, len(word), 0)]
    while work:
        a, z, k = work.pop()
        n = z - a
        if n < shortest:
            continue
        if k == ROUNDS:
            out.append((a, z))
            continue
        part = word[a:z].astype(np.uint64)
        gram = np.zeros(n - m + 1, np.uint64)
        for j in range(m):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + part[j : n - m + 1 + j]
        order = np.argsort(gram, kind="stable")
        equal = gram[order][1:] == gram[order][:-1]
        if not equal.any():
            continue
        again = np.zeros(n + 1, np.int64)
        hit = order[np.r_[equal, False] | np.r_[False, equal]]
        again[hit] += 1
        again[hit + m] -= 1
        covered = np.r_[False, np.cumsum(again)[:n] > 0, False]
        edge = np.flatnonzero(covered[1:] != covered[:-1])
        if len(edge) == 2 and edge[0] == 0 and edge[1] == n:
            out.append((a, z))
        else:
            work += [(a + x, a + y, k + 1) for x, y in zip(edge[::2].tolist(), edge[1::2].tolist())]
    return sorted(out)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def runs(words: list[bytes], shortest: int = 12) -> np.ndarray:
    """start, length, period of all runs, by start, then period."""
    known: dict[bytes, int] = {}
    word = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    found = [runs_in(word[a:z], shortest) + [a, 0, 0] for a, z in stretches(word, shortest)]
    if not found:
        return NONE
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]


def find(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """doc_id, start, length, period: a row for each run."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                found = runs(words_of(t.as_py()), shortest)
                if len(found):
                    ids = pa.array([i] * len(found), pa.int64())
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(found[:, k]) for k in range(3))], names=["doc_id", "start", "length", "period"])
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """docs with each run's repeats taken out of the text, whose words are then joined by one space. Texts without runs
    stay as they are, as null ones do."""
    def run(batches):
        for b in batches:
            texts = []
            for t in b.column("text").to_pylist():
                words = words_of(t)
                found = runs(words, shortest)
                texts.append(b" ".join(kept(words, found)).decode("utf-8", "surrogatepass") if len(found) else t)
            at = b.schema.names.index("text")
            yield b.set_column(at, "text", pa.array(texts, b.column("text").type))

    # the row's own columns stay in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), "text")
    rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame, shortest: int = 12) -> DataFrame:
    """doc_id, n_runs; start, length, period, exponent_milli of the longest run (ties: smallest start, then period; null
    without runs); runs_sha256 of `start,length,period` and a line feed for each run by start, then period;
    collapsed_sha256 of the words that are kept, joined by one space."""
    numbers = ("n_runs", "start", "length", "period", "exponent_milli")

    def run(batches):
        for b in batches:
            rows, digests = [], []
            for t in b.column("text"):
                words = words_of(t.as_py())
                found = runs(words, shortest)
                best = [None] * 4
                if len(found):
                    start, length, period = found[np.lexsort((found[:, 2], found[:, 0], -found[:, 1]))[0]].tolist()
                    best = [start, length, period, 1000 * length // period]
                rows.append([len(found), *best])
                digests.append((sha("".join(f"{s},{n},{p}\n" for s, n, p in found.tolist())), sha(b" ".join(kept(words, found)))))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)] + [pa.array([d[k] for d in digests], pa.string()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *numbers, "runs_sha256", "collapsed_sha256"])
        trim()

    kinds = ", ".join(f"{c} long" for c in numbers)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}, runs_sha256 string, collapsed_sha256 string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts made periodic from some word on: with h the CRC-32 of the id and g = h // 10,
    where h % 10 = 0 the words from a = g % n on are those from a to a + p over and over, p = 1 + (n - a) // (3 + g % 8)."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    cut = ids.withColumn("words", F.when(chosen, split)).withColumn("n", F.array_size("words")).withColumn("g", F.floor(F.col("h") / 10))
    cut = cut.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("concat_ws(' ', transform(sequence(0, n - 1), i -> get(words, int(if(i < a, i, a + (i - a) % p)))))")
    return cut.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))
