"""Removal of repeated passages, exact to the byte, by interval expansion on a Burrows-Wheeler transform.

A byte is removed if it is covered by a string of `least` bytes that also starts in a document with a smaller doc_id.
Texts are taken as UTF-8, matches never cross documents, and strings are judged on the input.

Work is split by content, so that equal strings meet in one task whatever documents they are in:

1. Documents are written in pieces of some MB, which are never larger than that but for one very long text.
2. Each window of `least` bytes has an anchor, the gram in it (see gram) with the smallest hash, leftmost first. Each
   piece tells its distinct anchors to the tasks that the hashes name, and hears which of them other pieces have too.
3. Consecutive windows with one anchor form a segment. The segments whose anchors several documents have go, each
   distinct one once for a piece, to the task of the anchor, with the doc_ids and places where they stand. Of an anchor
   that has very many different segments each window goes for itself, to the task that its own content names: there
   equal windows are brought together by their bytes, and the transform isn't needed.
4. There, distinct segments of anchors that have several are suffix-sorted and transformed. Common prefixes are derived
   by increasing value: where two neighbours in suffix order differ after n symbols, the intervals that stand before
   them break in two as well, so one backward step for all intervals at once gives the places with n + 1. At `least`
   symbols it ends; what hasn't broken is a class of equal windows, and has a smallest doc_id.
5. Each piece hears which of its windows also start in a smaller doc_id, and marks their bytes.

Rows between tasks hold lists: all that a piece has for a task. So there are never more rows than anchors or segments,
however many pieces and tasks there are.

Null texts are empty and stay null in dedup(); null doc_ids count as larger than all others. Rows with the same doc_id
don't remove each other's bytes; repeated rows lose the same. Extra columns, whatever their names, are kept by dedup()
and ignored by report(). An empty table gives nothing. A very long text is one piece, and needs some 20 times its size
of memory in its task.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, columns, free_name, numbered, sha, trim

PIECE = 4 << 20
#: Windows whose anchors are looked for at a time: their arrays stay in a core's cache.
CHUNK = 1 << 15
#: Bytes of text whose anchors one task gets.
SHARE = 16 << 20
#: From so many different segments on, counted by piece, an anchor's windows go one by one to the tasks that their
#: content names. Equal ones meet there and are brought together before the transform, which has nothing left to tell apart.
HOT = 20_000
#: Symbols that are suffix-sorted at a time, unless one anchor has more.
SYMBOLS = 30_000
#: Bytes of a list from which on it is squeezed.
SMALL = 2048
LAST = np.iinfo(np.int64).max
STANDS = np.dtype([("doc", "<i8"), ("first", "<u4")])
HIT = np.dtype([("first", "<u4"), ("windows", "<u8")])


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def dense(data: bytes) -> bytes:
    """Squeezed if that is worth it; the length of data tells."""
    return squeeze(data) if len(data) > SMALL else data


def undense(data: bytes, size: int) -> bytes:
    return unsqueeze(data) if size > SMALL else data


def planes(x: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte of all of them."""
    d = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    return dense(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unplanes(data: bytes, n: int) -> np.ndarray:
    d = np.frombuffer(undense(data, 8 * n), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(d.T).view("<u8").ravel(), dtype=np.uint64)


def gram(least: int) -> int:
    """Bytes of an anchor: nearly half a window, so that few anchors are shared by chance, also in a large corpus."""
    return least // 2 - 1


def slide(v: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width numbers."""
    done = 1
    while done < width:
        more = min(done, width - done)
        v = np.minimum(v[:-more], v[more:])
        done += more
    return v


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    return x


def hashes(buf: np.ndarray, k: int) -> np.ndarray:
    """Of each run of k bytes, put together from runs of powers of two."""
    n = len(buf) - k + 1
    run, size, out, done = buf.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & size:
            out = run[:n] if out is None else mixed(out) + run[done : done + n]
            done += size
        if done == k:
            break
        run = mixed(run[:-size]) + run[size:]
        size *= 2
    out = out * np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    return out


def segments(buf: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Segments of the documents buf[off[i]:off[i + 1]]: first and last window, hash of the anchor (48 bits), a hash of
    the segment's ends (16 bits), document."""
    found = []
    ends, k = off[1:-1], gram(least)
    number = np.arange(CHUNK + least, dtype=np.uint64)
    for a in range(0, max(0, len(buf) - least + 1), CHUNK):
        part = buf[a : a + CHUNK + least - 1]
        h = hashes(part, k)
        low = slide((h & np.uint64(0xFFFFFFFF << 32)) | number[: len(h)], least - k + 1)
        anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int32)
        inside = np.ones(len(anchor), bool)
        near = ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, a + len(part))]
        if len(near):
            cross = (near[:, None] - np.arange(1, least)).ravel() - a
            inside[cross[(cross >= 0) & (cross < len(inside))]] = False
        same = inside[1:] & inside[:-1] & (anchor[1:] == anchor[:-1])
        first = np.flatnonzero(inside & ~np.r_[False, same])
        last = np.flatnonzero(inside & ~np.r_[same, False])
        named = h[anchor[first]] * np.uint64(0xD6E8FEB86659FD93)  # anchors have small hashes: mixed again, they spread over the tasks
        named ^= named >> np.uint64(32)
        named *= np.uint64(0xD6E8FEB86659FD93)
        both = (h[first] * np.uint64(3)) ^ h[last + least - k]
        found.append((first + a, last + a, named >> np.uint64(16), both >> np.uint64(48)))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    first, last, h, ends_ = map(np.concatenate, zip(*found))
    return first, last, h, ends_, np.searchsorted(off, first, "right") - 1


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def blobs(stop: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in data; stop: where each ends, in elements, 0 first."""
    if int(stop[-1]) * data.itemsize > np.iinfo(np.int32).max:
        raise OverflowError("a list of more than 2 GB: texts in a piece, or segments of a bucket, are too many for one value")
    return pa.Array.from_buffers(pa.binary(), len(stop) - 1, [None, pa.py_buffer((stop * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.empty(0, np.int64)


def told(h: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The distinct anchors of a piece, ascending: hash, number of different segments (15 bits), and whether they are
    in several of its documents (lowest bit)."""
    key = h << np.uint64(16) | ends
    order = np.argsort(key)
    key, doc, h = key[order], doc[order], h[order]
    at = starts_of(h)
    if not len(at):
        return np.empty(0, np.uint64)
    different = np.add.reduceat(np.r_[True, key[1:] != key[:-1]].astype(np.int64), at)
    several = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
    return h[at] << np.uint64(16) | np.minimum(different, (1 << 15) - 1).astype(np.uint64) << np.uint64(1) | several.astype(np.uint64)


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of h are in known, which ascends."""
    if not len(known):
        return np.zeros(len(h), bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Piece:
    """Documents of one piece."""

    def __init__(self, data: bytes):
        n, size = struct.unpack("<qq", data[:16])
        body = unsqueeze(data[16:])
        self.ids = np.frombuffer(body, "<i8", n)
        self.off = np.frombuffer(body, "<i8", n + 1, 8 * n)
        at = 8 * (2 * n + 1)
        self.text = body[at : at + size]
        self.buf = np.frombuffer(self.text, np.uint8)
        self.rest = body[at + size :]


def write_piece(ids: list, texts: list[bytes], rest: bytes) -> bytes:
    off = np.cumsum([0] + [len(t) for t in texts], dtype="<i8")
    known = np.array([LAST if i is None else i for i in ids], "<i8")
    return struct.pack("<qq", len(ids), int(off[-1])) + squeeze(known.tobytes() + off.tobytes() + b"".join(texts) + rest)


def units(p: Piece, said: list[bytes], least: int) -> tuple[np.ndarray, ...]:
    """What is compared with other documents: segments whose anchors they have as well, and of hot anchors each window
    for itself. First and last window, hash that names the task, document."""
    first, last, h, ends, doc = segments(p.buf, p.off, least)
    line = told(h, ends, doc)
    heard = np.frombuffer(b"".join(said), "<u8")
    known = np.concatenate([line[(line & np.uint64(1)) > 0] >> np.uint64(16), heard >> np.uint64(1)])
    hot = heard[(heard & np.uint64(1)) > 0] >> np.uint64(1)
    known.sort()
    hot.sort()
    own = np.flatnonzero(among(h, known))
    first, last, h, doc = first[own], last[own], h[own], doc[own]
    if len(hot) and (split := among(h, hot)).any():
        n = np.where(split, last - first + 1, 1)
        row = np.repeat(np.arange(len(h)), n)
        first = first[row] + np.where(split[row], np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), 0)
        split, last, h, doc = split[row], last[row], h[row], doc[row]
        last = np.where(split, first, last)
        h[split] = np.fromiter((xxhash.xxh64_intdigest(p.text[a : a + least]) >> 16 for a in first[split].tolist()), np.uint64, int(split.sum()))
    return first, last, h, doc


def texts_of(buf: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    stop = np.r_[0, np.cumsum(size)]
    at = np.repeat(first - stop[:-1], size) + np.arange(stop[-1])
    return blobs(stop, buf[at])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each binary value ends in the flat bytes, 0 first, and these."""
    stop = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    flat = np.frombuffer(texts.buffers()[2], np.uint8)[stop[0] : stop[-1]] if stop[-1] > stop[0] else np.empty(0, np.uint8)
    return stop - stop[0], flat


SENT = pa.schema([("bucket", pa.int64()), ("piece", pa.int64()), ("h", pa.binary()), ("size", pa.binary()), ("times", pa.binary()), ("stands", pa.binary()), ("text", pa.binary())])
SENT_SQL = "bucket long, piece long, h binary, size binary, times binary, stands binary, text binary"


def entries(p: Piece, name: int, said: list[bytes], buckets: int, least: int):
    """Rows of SENT: by bucket, the distinct units of a piece and where each stands."""
    first, last, h, doc = units(p, said, least)
    if not len(first):
        return
    coded = texts_of(p.buf, first, last - first + least).dictionary_encode()
    code, text = coded.indices.to_numpy(), coded.dictionary
    order = np.argsort(code, kind="stable")
    at = starts_of(code[order])
    stands = np.empty(len(order), STANDS)
    stands["doc"], stands["first"] = p.ids[doc[order]], first[order]
    h, times = h[order][at], np.diff(np.r_[at, len(order)])
    stands = blobs(np.r_[at, len(order)], stands)
    order = np.argsort(h)
    h, times = h[order], times[order].astype("<u4")
    size = (last - first + least).astype("<u2")[np.unique(code, return_index=True)[1]][order]
    stands, text = stands.take(pa.array(order)), text.take(pa.array(order))
    bucket = bucket_of(h, buckets)
    at = starts_of(bucket)
    stop = np.r_[at, len(h)]
    (stand_stop, stands), (text_stop, text) = bytes_of(stands), bytes_of(text)
    texts = [dense(text[a:z].tobytes()) for a, z in zip(text_stop[stop], text_stop[stop[1:]])]
    yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(np.full(len(at), name)), blobs(stop, h), blobs(stop, size), blobs(stop, times), blobs(stand_stop[stop], stands), pa.array(texts, pa.binary())], schema=SENT)


def ranked(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys of so many bits, and the number of each key among the different ones, from 1 on."""
    n = len(key)
    wide = n.bit_length()
    if bits + wide <= 64:  # key and place as one number: sorted by value
        both = key << np.uint64(wide) | np.arange(n, dtype=np.uint64)
        both.sort()
        order, key = (both & np.uint64((1 << wide) - 1)).astype(np.int64), both >> np.uint64(wide)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.r_[True, key[1:] != key[:-1]]).astype(np.uint64)
    return order, rank


def suffix_array(sym: np.ndarray, rest: np.ndarray, least: int) -> np.ndarray:
    """Places of sym (0 ends each string) sorted by the first `least` symbols at least of the rest of their string.
    rest: symbols before the next 0. Some symbols first, then twice as many each time."""
    n = len(sym)
    code = np.cumsum(np.bincount(sym, minlength=1) > 0) - 1  # the symbols in use, without gaps; 0 is
    sym = code[sym].astype(np.uint64)
    bits = int(code[-1]).bit_length()
    done = min(max(1, (64 - n.bit_length()) // bits), least)
    key = np.zeros(n, np.uint64)
    for j in range(done):
        key <<= np.uint64(bits)
        key[: n - j] |= np.where(rest[: n - j] > j, sym[j:], 0)
    order, rank = ranked(key, done * bits)
    while done < least:
        top = int(rank.max())
        if top == n:
            break
        after = np.zeros(n, np.uint64)
        after[: n - done] = np.where(rest[: n - done] >= done, rank[done:], 0)
        order, rank = ranked(rank << np.uint64(top.bit_length()) | after, 2 * top.bit_length())
        done *= 2
    return order


def common_prefixes(sym: np.ndarray, sa: np.ndarray, least: int) -> np.ndarray:
    """How many symbols the suffixes at sa[i - 1] and sa[i] have in common, up to `least`; no 0 equals another.

    The transform tells what stands before each suffix; here it is used the other way, from a suffix to the one that
    it stands before (`after`). A place is a break once its value is known. Values come by increasing size: suffixes
    with the same first symbol differ after n + 1 if the shortest break between what follows them is n."""
    n = len(sym)
    rank = np.empty(n, np.int32)
    rank[sa] = np.arange(n, dtype=np.int32)
    after = np.zeros(n, np.int32)
    after[:] = rank[np.minimum(sa + 1, n - 1)]
    head = sym[sa]
    out = np.full(n, least, np.int32)
    broken = np.r_[True, (head[1:] != head[:-1]) | (head[1:] == 0)]
    out[broken] = 0
    open_ = np.flatnonzero(~broken).astype(np.int32)
    low, high = np.minimum(after[open_ - 1], after[open_]), np.maximum(after[open_ - 1], after[open_])
    for value in range(1, least):
        before = np.cumsum(broken, dtype=np.int32)
        new = before[low] != before[high]
        found = open_[new]
        if not len(found):
            break
        broken[found] = True
        out[found] = value
        keep = ~new
        open_, low, high = open_[keep], low[keep], high[keep]
    return out


def classes(flat: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings of size[i] bytes lie one after the other in flat. Returns the windows (places in flat of which `least`
    bytes follow in their string) in suffix order, and the number of their class, ascending: equal windows have one."""
    n = len(flat) + len(size)
    owner = np.repeat(np.arange(len(size)), size + 1)
    start = np.cumsum(size + 1) - size - 1
    rest = size[owner] - (np.arange(n) - start[owner])
    sym = np.zeros(n, np.int64)
    sym[rest > 0] = flat.astype(np.int64) + 1
    sa = suffix_array(sym, rest, least)
    group = np.cumsum(common_prefixes(sym, sa, least) < least)
    window = rest[sa] >= least
    at = sa[window]
    return at - owner[at], group[window]


def smaller(h: np.ndarray, text: pa.Array, stands: np.ndarray, row: np.ndarray, least: int) -> np.ndarray:
    """text: strings in rows, h: by row; stands: where they stand, of row `row`. For each of these a mask of the
    windows that also start in a doc_id smaller than its own."""
    coded = text.dictionary_encode()
    own, strings = coded.indices.to_numpy()[row], coded.dictionary
    count = len(strings)
    stop, flat = bytes_of(strings)
    begin, length = stop[:-1], np.diff(stop)
    lot = np.empty(count, np.uint64)
    lot[coded.indices.to_numpy()] = h
    doc = stands["doc"]
    low = np.full(count, LAST)
    np.minimum.at(low, own, doc)
    windows = length - least + 1
    first = np.cumsum(windows) - windows
    least_doc = np.repeat(low, windows)
    order = np.argsort(lot)
    at = starts_of(lot[order])
    many = np.repeat(np.diff(np.r_[at, count]) > 1, np.diff(np.r_[at, count]))  # a string alone under its anchor has no window in common with others
    pick, anchor = order[many], lot[order][many]
    done = np.cumsum(length[pick] + 1)
    a = 0
    while a < len(pick):  # some whole anchors at a time
        z = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + SYMBOLS, "right")))
        if z < len(pick) and anchor[z] == anchor[z - 1]:
            whole = int(np.searchsorted(anchor, anchor[z - 1]))
            z = whole if whole > a else int(np.searchsorted(anchor, anchor[z - 1], "right"))
        part, a = pick[a:z], z
        end = np.cumsum(length[part])
        inner = np.repeat(begin[part] - np.r_[0, end[:-1]], length[part]) + np.arange(end[-1])
        place, group = classes(flat[inner], length[part], least)
        string = np.searchsorted(end, place, "right")
        window = first[part][string] + place - (end[string] - length[part][string])
        start = starts_of(group)
        best = np.minimum.reduceat(low[part][string], start)
        least_doc[window] = np.repeat(best, np.diff(np.r_[start, len(group)]))
    out = np.zeros(len(own), np.uint64)
    for offset in range(int(windows.max(initial=0))):
        here = np.flatnonzero(windows[own] > offset)
        out[here] |= (least_doc[first[own[here]] + offset] < doc[here]).astype(np.uint64) << np.uint64(offset)
    return out


def covered(p: Piece, heard: list[bytes], least: int) -> np.ndarray:
    """Which bytes of a piece are removed."""
    hits = np.frombuffer(b"".join(heard), HIT)
    first, windows = hits["first"].astype(np.int64), hits["windows"]
    edge = np.zeros(len(p.buf) + 1, np.int32)
    for offset in range(least - gram(least) + 1):
        start = first[(windows >> np.uint64(offset) & np.uint64(1)) > 0] + offset
        edge[start] += 1  # a window is in one unit only
        edge[start + least] -= 1
    return np.cumsum(edge[:-1]) > 0


def gathered(batches, names: list[str]) -> pa.Table | None:
    """All rows of a partition; its size is set by the number of buckets."""
    found = [b.select(names) for b in batches if len(b)]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def marked(docs: DataFrame, least: int, scratch: Scratch, share: int | None) -> DataFrame:
    """data, hits: pieces (see Piece; rest: the columns of the piece's rows other than text, as an Arrow stream, with
    a last column that tells null texts) and what covered() asks for."""
    k = gram(least)
    if k < 8 or least - k + 1 > 64:
        raise ValueError("least must be from 18 to 124")
    names = [c for c in docs.columns if c != "text"]
    null = free_name(docs, "null")

    def cut(batches):
        def piece(rows, texts):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as w:
                w.write_batch(rows)
            ids = rows.column("doc_id").cast(pa.int64()).to_pylist()
            data = write_piece(ids, [t or b"" for t in texts], sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary()), pa.array([sum(len(t or b"") for t in texts)], pa.int64())], names=["data", "size"])

        for b in batches:
            rows, texts, a, size = b.select(names).append_column(null, b.column("text").is_null()), [], 0, 0
            for i, t in enumerate(b.column("text")):
                t = t.as_py()
                t = None if t is None else t.encode("utf-8", "surrogatepass")
                if texts and size + len(t or b"") > PIECE:
                    yield piece(rows.slice(a, i - a), texts)
                    texts, a, size = [], i, 0
                texts.append(t)
                size += len(t or b"")
            if texts:
                yield piece(rows.slice(a, len(b) - a), texts)

    cut_docs = docs.select(*columns(docs, "text"), "text").mapInArrow(cut, "data binary, size long").withColumn("piece", F.monotonically_increasing_id())
    pieces = scratch.write("pieces", cut_docs)
    total = pieces.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (share or SHARE)), min(2 * docs.sparkSession.sparkContext.defaultParallelism, total // (1 << 20)))
    pieces = pieces.select("piece", "data")  # the same columns for both joins: their exchange is one

    def tell(batches):
        for b in batches:
            for name, data in zip(b.column("piece").to_pylist(), b.column("data")):
                p = Piece(data.as_py())
                _, _, h, ends, doc = segments(p.buf, p.off, least)
                line = told(h, ends, doc)
                bucket = bucket_of(line >> np.uint64(16), buckets)
                at = starts_of(bucket)
                stop = np.r_[at, len(line)].tolist()
                lots = [planes(line[a:z]) for a, z in zip(stop, stop[1:])] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(np.full(len(at), name)), pa.array(np.diff(np.r_[at, len(line)])[: len(at)]), pa.array(lots, pa.binary())], names=["bucket", "piece", "n", "lines"])
        trim()

    def answer(batches):
        rows = gathered(batches, ["piece", "n", "lines"])
        if rows is None:
            return
        n = rows.column("n").to_numpy()
        line = np.concatenate([unplanes(x.as_py(), k) for x, k in zip(rows.column("lines"), n.tolist())])
        who = np.repeat(rows.column("piece").to_numpy(), n)
        order = np.argsort(line)
        line, who = line[order], who[order]
        h = line >> np.uint64(16)
        at = starts_of(h)
        pieces_of = np.diff(np.r_[at, len(h)])
        different = np.add.reduceat((line >> np.uint64(1) & np.uint64(0x7FFF)).astype(np.int64), at)
        hot = np.repeat(different >= HOT, pieces_of)
        say = np.repeat(pieces_of > 1, pieces_of) & ~(line & np.uint64(1)).astype(bool) | hot
        said, who = (h << np.uint64(1) | hot.astype(np.uint64))[say], who[say]
        order = np.argsort(who, kind="stable")
        said, who = said[order], who[order]
        at = starts_of(who)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(who[at]), blobs(np.r_[at, len(who)], said)], names=["piece", "said"])
        del rows, line, who, order, h, said
        trim()

    lines = pieces.mapInArrow(tell, "bucket long, piece long, n long, lines binary")
    heard = lines.repartition(buckets, "bucket").mapInArrow(answer, "piece long, said binary")
    heard = scratch.write("heard", heard.groupBy("piece").agg(F.collect_list("said").alias("said")))  # no more than a piece has anchors

    def send(batches):
        for b in batches:
            for name, data, said in zip(b.column("piece").to_pylist(), b.column("data"), b.column("said")):
                yield from entries(Piece(data.as_py()), name, said.as_py() or [], buckets, least)
        trim()

    def compare(batches):
        rows = gathered(batches, SENT.names[1:])
        if rows is None:
            return
        h, size, times = (np.frombuffer(b"".join(rows.column(c).to_pylist()), kind) for c, kind in (("h", "<u8"), ("size", "<u2"), ("times", "<u4")))
        stands = np.frombuffer(b"".join(rows.column("stands").to_pylist()), STANDS)
        n = np.array([len(x.as_buffer()) // 8 for x in whole(rows.column("h"))])
        each = np.add.reduceat(size.astype(np.int64), np.cumsum(n) - n)
        text = b"".join(undense(t, k) for t, k in zip(rows.column("text").to_pylist(), each.tolist()))
        text = blobs(np.r_[0, np.cumsum(size, dtype=np.int64)], np.frombuffer(text, np.uint8))
        row = np.repeat(np.arange(len(h)), times)
        who = np.repeat(rows.column("piece").to_numpy(), n)[row]
        mask = smaller(h, text, stands, row, least)
        hit = np.flatnonzero(mask)
        hit = hit[np.argsort(who[hit], kind="stable")]
        out = np.empty(len(hit), HIT)
        out["first"], out["windows"] = stands["first"][hit], mask[hit]
        at = starts_of(who[hit])
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(who[hit][at]), blobs(np.r_[at, len(hit)], out)], names=["piece", "hits"])
        del rows, h, size, times, stands, text, row, who, mask, hit, out
        trim()

    sent = pieces.join(heard, "piece", "left").mapInArrow(send, SENT_SQL)
    hits = sent.repartition(buckets, "bucket").mapInArrow(compare, "piece long, hits binary")
    hits = hits.groupBy("piece").agg(F.collect_list("hits").alias("hits"))  # no more than a piece has segments
    return pieces.join(hits, "piece", "left").select("data", "hits")


def opened(batches, least: int):
    """Pieces with the bytes they lose, and the other columns of their rows."""
    for b in batches:
        for data, hits in zip(b.column("data"), b.column("hits")):
            p = Piece(data.as_py())
            yield p, covered(p, hits.as_py() or [], least), pa.ipc.open_stream(p.rest).read_next_batch()
    trim()


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame, least: int = 50, share: int | None = None) -> DataFrame:
    """Of each row: what it loses, and the hash of the bytes that are left. share: bytes of text whose anchors a task gets."""
    scratch = Scratch(docs.sparkSession)
    rows = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least, scratch, share)
    names = [x.split(" ")[0] for x in REPORT.split(", ")]

    def run(batches):
        for p, lost, rest in opened(batches, least):
            out = []
            for a, z in zip(p.off.tolist(), p.off[1:].tolist()):
                gone = lost[a:z]
                out.append((z - a, int(np.count_nonzero(gone)), int(np.count_nonzero(gone[1:] > gone[:-1])) + int(z > a and gone[0]), sha(p.buf[a:z][~gone].tobytes())))
            yield pa.RecordBatch.from_arrays([rest.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=names)

    out = scratch.write("report", rows.mapInArrow(run, REPORT))
    scratch.drop("pieces", "heard")
    return out


def dedup(docs: DataFrame, least: int = 50, share: int | None = None) -> DataFrame:
    """docs without the repeated passages. A character goes if all its bytes do; a text that loses all of it goes as
    a row. n_chars, if there is such a column, is counted again where the text isn't null. share: bytes of text whose anchors a task gets: less takes less memory in it."""
    scratch = Scratch(docs.sparkSession)
    plain = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    inner = numbered(plain, "doc_id", "text", "n_chars")
    rows = marked(inner, least, scratch, share)
    names = inner.columns
    null = free_name(inner, "null")

    def run(batches):
        for p, lost, rest in opened(batches, least):
            lead = np.flatnonzero((p.buf & 0xC0) != 0x80)
            kept = ~lost
            if len(lead):  # texts begin with whole characters
                kept = np.repeat(np.maximum.reduceat(kept, lead), np.diff(np.r_[lead, len(kept)]))
            texts, stay = [], []
            for a, z, none in zip(p.off.tolist(), p.off[1:].tolist(), rest.column(null).to_pylist()):
                t = p.buf[a:z][kept[a:z]].tobytes()
                stay.append(bool(t) or a == z)
                texts.append(None if none else t.decode("utf-8", "surrogatepass"))
            found = {c: rest.column(c) for c in rest.schema.names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                counted = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(found["n_chars"].type)
                found["n_chars"] = pc.coalesce(counted, found["n_chars"])
            yield pa.RecordBatch.from_arrays([found[c] for c in names], names=names).filter(pa.array(stay))

    return rows.mapInArrow(run, inner.schema).toDF(*plain.columns)
