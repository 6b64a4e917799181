"""Lossless WebP in numpy: a decoder of the whole format, and a writer.

The decoder reads prefix codes, back-references and the colour cache of many images at once: image after image holds a
lane, and each step takes one pixel of every lane from arrays. Predictor, cross-colour, subtract-green and palette
transforms are then inverted, the first of them lane by lane as well. Pixels are unsigned 32-bit numbers, alpha red
green blue from the highest byte to the lowest.

Files are RIFF with one VP8L chunk, or with an animation whose frames are VP8L strips of one picture.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
LENGTH_CODES = 24
LITERALS = 256
DISTANCES = 40
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


@lru_cache(1)
def near() -> np.ndarray:
    """Offsets of the 120 short distance codes: the near places by distance, then by column, right before left."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return np.array(sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)), np.int64)


@lru_cache(16)
def reversed_bits(n: int) -> np.ndarray:
    i = np.arange(1 << n)
    out = np.zeros_like(i)
    for b in range(n):
        out |= (i >> b & 1) << (n - 1 - b)
    return out


class Bits:
    """Reads bits from the lowest of each byte on; at is the place in bits."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.data):
            raise ValueError("the data end too soon")
        got = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return got

    def same(self, a: int, b: int, n: int) -> bool:
        """Whether the n bits from a and from b are there and equal."""
        if b + n > 8 * len(self.data):
            return False
        x, y = (int.from_bytes(self.data[k >> 3 : (k + n + 7) >> 3], "little") >> (k & 7) for k in (a, b))
        return not (x ^ y) & ((1 << n) - 1)


def lookup(lengths: np.ndarray) -> np.ndarray:
    """For each value of the next bits: symbol << 4 | length of the canonical code. One symbol alone takes no bits."""
    used = np.flatnonzero(lengths)
    if not len(used):
        return np.zeros(1, np.int64)
    if len(used) == 1:
        return np.array([used[0] << 4], np.int64)
    order = used[np.argsort(lengths[used], kind="stable")]
    size, most = lengths[order].astype(np.int64), int(lengths.max())
    share = 1 << (most - size)
    if share.sum() != 1 << most:
        raise ValueError("a prefix code is not complete")
    return np.repeat(order << 4 | size, share)[reversed_bits(most)]


def read_lengths(bits: Bits, alphabet: int) -> np.ndarray:
    lengths = [0] * alphabet
    if bits.take(1):  # simple
        two, wide = bits.take(1), bits.take(1)
        lengths[bits.take(8 if wide else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return np.array(lengths)
    own = np.zeros(19, np.int64)
    for k in CODE_LENGTH_ORDER[: 4 + bits.take(4)]:
        own[k] = bits.take(3)
    codes = lookup(own).tolist()
    width = (len(codes) - 1).bit_length()
    left = alphabet
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    at, last = 0, 8
    pos, next_byte = bits.at, (bits.at >> 3) + 64
    window = int.from_bytes(bits.data[bits.at >> 3 : next_byte], "little") >> (bits.at & 7)
    mask = (1 << width) - 1
    while at < alphabet and left:
        left -= 1
        if 8 * next_byte - pos < 16:
            window |= int.from_bytes(bits.data[next_byte : next_byte + 64], "little") << (8 * next_byte - pos)
            next_byte += 64
        code = codes[window & mask]
        window >>= code & 15
        pos += code & 15
        code >>= 4
        if code < 16:
            lengths[at] = code
            last = code or last
            at += 1
            continue
        value, extra, base = ((last, 2, 3), (0, 3, 3), (0, 7, 11))[code - 16]
        n = base + (window & ((1 << extra) - 1))
        window >>= extra
        pos += extra
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        lengths[at : at + n] = [value] * n
        at += n
    bits.at = pos
    return np.array(lengths)


@dataclass
class Image:
    """One entropy-coded image: where its pixels begin, and its codes."""

    data: bytes
    at: int
    width: int
    height: int
    cache_bits: int
    codes: list[list[np.ndarray]]  # by group: green, red, blue, alpha, distance
    groups: np.ndarray | None = None  # group of each block
    block_bits: int = 0
    pixels: np.ndarray | None = None

    @property
    def special(self) -> bool:
        """Whether there may be anything but literals."""
        return self.cache_bits > 0 or self.groups is not None or any(int(g[0].max()) >> 4 >= LITERALS for g in self.codes)


@dataclass
class File:
    width: int
    height: int
    image: Image
    transforms: list[tuple] = field(default_factory=list)


#: Tables of code lengths met lately, by the lengths.
_tables: dict[bytes, np.ndarray] = {}


def table(lengths: np.ndarray) -> np.ndarray:
    key = lengths.astype(np.uint8).tobytes()
    if key not in _tables:
        if len(_tables) > 2000:
            _tables.clear()
        _tables[key] = lookup(lengths)
    return _tables[key]


def read_codes(bits: Bits, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """A group's tables. A code that stands there in the bits of the one before it is not read again."""
    codes, last, start, n = [], 0, 0, 0
    for size in sizes:
        if size == last and bits.same(start, bits.at, n):
            start, bits.at = bits.at, bits.at + n
            codes.append(codes[-1])
            continue
        last, start = size, bits.at
        codes.append(table(read_lengths(bits, size)))
        n = bits.at - start
    return codes


def read_image(bits: Bits, width: int, height: int, whole: bool) -> Iterator[Image]:
    """Returns the image with its codes. Like the two below, it yields images of the header that it needs decoded, and
    is sent where in bits their data end."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, block_bits, n = None, 0, 1
    if whole and bits.take(1):
        block_bits = bits.take(3) + 2
        part = yield from sub_image(bits, -(-width >> block_bits), -(-height >> block_bits))
        groups = (part >> 8 & 0xFFFF).astype(np.int64)
        n = int(groups.max()) + 1
    sizes = (LITERALS + LENGTH_CODES + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
    codes = [read_codes(bits, sizes) for _ in range(n)]
    return Image(bits.data, bits.at, width, height, cache_bits, codes, groups, block_bits)


def sub_image(bits: Bits, width: int, height: int) -> Iterator[Image]:
    image = yield from read_image(bits, width, height, False)
    bits.at = int((yield image))
    return image.pixels


def read_file(data: bytes) -> Iterator[Image]:
    """Headers, transforms and codes of a VP8L chunk, as a File."""
    bits = Bits(data)
    if bits.take(8) != 0x2F:
        raise ValueError("no lossless WebP")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    transforms, now = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.take(3) + 2
            transforms.append((kind, now, size, (yield from sub_image(bits, -(-now >> size), -(-height >> size)))))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, now))
        else:
            n = bits.take(8) + 1
            parts = (yield from sub_image(bits, n, 1)).view(np.uint8).reshape(-1, 4)
            colours = np.cumsum(parts, axis=0, dtype=np.uint8).view(np.uint32).ravel()
            pack = pack_of(n)
            transforms.append((kind, now, pack, colours))
            now = -(-now >> pack)
    return File(width, height, (yield from read_image(bits, now, height, True)), transforms)


def read_files(chunks: list[bytes]) -> list[File]:
    """What read_file returns for each; the images in the headers of all are decoded side by side."""
    readers = [read_file(c) for c in chunks]
    files, ends = [None] * len(chunks), dict.fromkeys(range(len(chunks)))
    while ends:
        asked = {}
        for i, end in ends.items():
            try:
                asked[i] = readers[i].send(end)
            except StopIteration as done:
                files[i] = done.value
        ends = dict(zip(asked, decode_lanes([*asked.values()]))) if asked else {}
    return files


def decode_lanes(images: list[Image]) -> np.ndarray:
    """Sets the pixels of each image; returns where in bits its data end."""
    order = sorted(range(len(images)), key=lambda i: -images[i].width * images[i].height)
    lanes = [images[i] for i in order]
    blobs = {id(x.data): x.data for x in lanes}
    begin, size = {}, 0
    for k, d in blobs.items():
        begin[k] = size
        size += len(d) + 8
    flat = np.zeros(size + 8, np.uint8)
    for k, d in blobs.items():
        flat[begin[k] : begin[k] + len(d)] = np.frombuffer(d, np.uint8)
    ahead = np.zeros(size, np.uint64)  # the eight bytes from each byte on
    for b in range(8):
        ahead |= flat[b : size + b].astype(np.uint64) << np.uint64(8 * b)
    last = size - 1

    # all tables in one array; by lane, group and code the place and the mask of one
    place: dict[int, int] = {}
    parts, top = [], 0
    base = np.cumsum([0] + [len(x.codes) for x in lanes])
    where = np.zeros((base[-1], 5), np.int64)
    mask = np.zeros((base[-1], 5), np.uint64)
    row = 0
    for x in lanes:
        for group in x.codes:
            for c, t in enumerate(group):
                if id(t) not in place:
                    place[id(t)] = top
                    parts.append(t)
                    top += len(t)
                where[row, c], mask[row, c] = place[id(t)], len(t) - 1
            row += 1
    entries = np.concatenate(parts)
    where, mask = np.ascontiguousarray(where.T), np.ascontiguousarray(mask.T)

    count = np.array([x.width * x.height for x in lanes])
    width = np.array([x.width for x in lanes])
    start = np.cumsum(np.r_[0, count])
    out = np.zeros(start[-1], np.uint32)
    pos = np.array([begin[id(x.data)] * 8 + x.at for x in lanes])
    group = base[:-1].copy()
    grouped = [i for i, x in enumerate(lanes) if x.groups is not None]
    cached = np.array([x.cache_bits for x in lanes])
    any_cache = bool(cached.any())
    cached[cached == 0] = 1  # one that nothing reads
    cache_shift = (32 - cached).astype(np.uint32)
    cache_at = np.cumsum(np.r_[0, 1 << cached])
    cache = np.zeros(cache_at[-1] + 1, np.uint32)
    left, back = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    copying = False
    u3, u7, u15 = 3, 7, 15
    every = np.arange(len(lanes))

    def extra(lane, prefix):
        """The value of prefix codes of lengths or distances, with the extra bits that follow."""
        n = np.maximum(prefix - 2, 0) >> 1
        w = ahead[np.minimum(pos[lane] >> 3, last)] >> (pos[lane] & 7).astype(np.uint64)
        more = (w & ((np.uint64(1) << n.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        pos[lane] += n
        return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << n) + more) + 1

    k = len(lanes)
    step = 0
    while k:
        while k and count[k - 1] <= step:
            k -= 1
        if not k:
            break
        for i in grouped:
            if i < k:
                x = lanes[i]
                y, col = divmod(step, x.width)
                if not col & ((1 << x.block_bits) - 1):
                    group[i] = base[i] + x.groups[(y >> x.block_bits) * -(-x.width >> x.block_bits) + (col >> x.block_bits)]
        if copying:
            held = left[:k] > 0
            fresh = np.flatnonzero(~held)
            held = np.flatnonzero(held)
            copying = bool(len(held))
        else:
            fresh, held = slice(0, k), None
        p, g = pos[fresh], group[fresh] if grouped else fresh
        w = ahead[np.minimum(p >> u3, last)] >> (p & u7).astype(np.uint64)
        e = entries[where[0][g] + (w & mask[0][g]).astype(np.int64)]
        n = e & u15
        green = e >> 4
        special = green >= LITERALS
        w >>= n.astype(np.uint64)
        p = p + n
        mixed = special.any()
        if mixed:
            lane = every[:k] if held is None else fresh
            plain = np.flatnonzero(~special)
            lit, all_p, all_green = lane[plain], p, green
            p, w, green, g = p[plain], w[plain], green[plain], group[lit] if grouped else lit
        e = entries[where[1][g] + (w & mask[1][g]).astype(np.int64)]
        n = e & u15
        w >>= n.astype(np.uint64)
        p += n
        argb = green << 8 | e >> 4 << 16
        e = entries[where[2][g] + (w & mask[2][g]).astype(np.int64)]
        p += e & u15
        argb |= e >> 4
        w = ahead[np.minimum(p >> u3, last)] >> (p & u7).astype(np.uint64)
        e = entries[where[3][g] + (w & mask[3][g]).astype(np.int64)]
        p += e & u15
        argb |= e >> 4 << 24
        if not mixed:
            pos[fresh] = p
            out[start[:k][fresh] + step] = argb
        else:
            all_p[plain] = p
            pos[lane] = all_p
            green = all_green
            out[start[lit] + step] = argb
            from_cache = np.flatnonzero(green >= LITERALS + LENGTH_CODES)
            if len(from_cache):
                own = lane[from_cache]
                out[start[own] + step] = cache[cache_at[own] + green[from_cache] - LITERALS - LENGTH_CODES]
            refs = np.flatnonzero(special & (green < LITERALS + LENGTH_CODES))
            if len(refs):
                own = lane[refs]
                length = extra(own, green[refs] - LITERALS)
                w = ahead[np.minimum(pos[own] >> 3, last)] >> (pos[own] & 7).astype(np.uint64)
                e = entries[where[4][group[own]] + (w & mask[4][group[own]]).astype(np.int64)]
                pos[own] += e & 15
                code = extra(own, e >> 4)
                place_of = near()[np.minimum(code, 120) - 1]
                dist = np.where(code > 120, code - 120, np.maximum(1, place_of[:, 0] + place_of[:, 1] * width[own]))
                if (dist > step).any():
                    raise ValueError("a back-reference points before the image")
                left[own], back[own] = length, dist
                held = own if held is None else np.concatenate([held, own])
                copying = True
        if held is not None and len(held):
            out[start[held] + step] = out[start[held] + step - back[held]]
            left[held] -= 1
        if any_cache:
            colour = out[start[:k] + step]
            at = (colour * np.uint32(CACHE_FACTOR)) >> cache_shift[:k]
            cache[cache_at[:k] + at.astype(np.int64)] = colour
        step += 1
    done = np.zeros(len(images), np.int64)
    for j, (i, x) in enumerate(zip(order, lanes)):
        done[i] = pos[j] - begin[id(x.data)] * 8
        if done[i] > 8 * len(x.data):
            raise ValueError("the data end too soon")
        x.pixels = out[start[j] : start[j + 1]]
    return done


def mean2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (((a ^ b) & np.uint32(0xFEFEFEFE)) >> np.uint32(1)) + (a & b)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By channel, modulo 256."""
    low, high = np.uint32(0x00FF00FF), np.uint32(0xFF00FF00)
    return (((a & low) + (b & low)) & low) | (((a & high) + (b & high)) & high)


def channels(a: np.ndarray, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.uint8).reshape(-1, 4).astype(kind)


def joined(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint8).view(np.uint32).ravel()


def predicted(mode: int, left, top, corner, right) -> np.ndarray:
    """What a mode predicts from the pixels to the left, above, above left and above right."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean2(mean2(left, right), top)
    if mode == 6:
        return mean2(left, corner)
    if mode == 7:
        return mean2(left, top)
    if mode == 8:
        return mean2(corner, top)
    if mode == 9:
        return mean2(top, right)
    if mode == 10:
        return mean2(mean2(left, corner), mean2(top, right))
    if mode in (11, 12, 13):
        a, b, c = channels(left), channels(top), channels(corner)
        if mode == 11:
            to_left, to_top = abs(b - c).sum(1), abs(a - c).sum(1)
            return np.where(to_left < to_top, left, top)
        if mode == 12:
            return joined(np.clip(a + b - c, 0, 255))
        m = channels(mean2(left, top))
        half = m - c
        return joined(np.clip(m + np.sign(half) * (abs(half) // 2), 0, 255))
    return np.full(len(left), 0xFF000000, np.uint32)


def undo_predictor(files: list[tuple[np.ndarray, int, int, np.ndarray]]) -> list[np.ndarray]:
    """residuals, width, block bits and modes of many images, to pixels: a step takes one pixel of each."""
    order = sorted(range(len(files)), key=lambda i: -len(files[i][0]))
    width = np.array([files[i][1] for i in order])
    count = np.array([len(files[i][0]) for i in order])
    start = np.cumsum(np.r_[0, count])
    out = np.concatenate([files[i][0] for i in order]).astype(np.uint32)
    mode = []
    for i in order:
        pixels, w, bits, modes = files[i]
        at = np.arange(len(pixels))
        mode.append((modes >> 8 & 15)[(at // w >> bits) * -(-w >> bits) + (at % w >> bits)])
    mode = np.concatenate(mode).astype(np.int64)
    k = len(files)
    for step in range(int(count.max(initial=0))):
        while count[k - 1] <= step:
            k -= 1
        at = start[:k] + step
        w = width[:k]
        col, row = step % w, step // w
        m = mode[at]
        m = np.where(row == 0, np.where(col == 0, 0, 1), np.where(col == 0, 2, m))
        for kind in np.unique(m):
            own = np.flatnonzero(m == kind)
            a, ww = at[own], w[own]
            zero = np.zeros(len(own), np.uint32)
            if kind == 0:
                guess = zero + np.uint32(0xFF000000)
            elif kind == 1:
                guess = out[a - 1]
            else:
                guess = predicted(int(kind), out[a - 1], out[a - ww], out[np.maximum(a - ww - 1, 0)], out[a - ww + 1])
            out[a] = add(out[a], guess)
    found = [np.empty(0, np.uint32)] * len(files)
    for j, i in enumerate(order):
        found[i] = out[start[j] : start[j + 1]]
    return found


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(x.dtype)


def blocks(n: int, width: int, bits: int, values: np.ndarray) -> np.ndarray:
    at = np.arange(n)
    return values[(at // width >> bits) * -(-width >> bits) + (at % width >> bits)]


def crossed(pixels: np.ndarray, values: np.ndarray, undo: bool = True) -> np.ndarray:
    """The cross-colour transform or its inverse, with the values of each pixel."""
    own, c = channels(values, np.int16), channels(pixels, np.int16)  # blue, green, red, alpha
    sign = 1 if undo else -1
    green = signed(c[:, 1])
    red = c[:, 2] + sign * (signed(own[:, 0]) * green >> 5)
    blue = c[:, 0] + sign * (signed(own[:, 1]) * green >> 5) + sign * (signed(own[:, 2]) * signed((red if undo else c[:, 2]) & 255) >> 5)
    return joined(np.stack([blue & 255, c[:, 1], red & 255, c[:, 3]], 1))


def cross_colour(pixels: np.ndarray, width: int, bits: int, values: np.ndarray, undo: bool = True) -> np.ndarray:
    return crossed(pixels, blocks(len(pixels), width, bits, values), undo)


def pack_of(colours: int) -> int:
    """The binary logarithm of how many indexes of a palette share a pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpack(pixels: np.ndarray, width: int, height: int, pack: int, colours: np.ndarray) -> np.ndarray:
    index = (pixels >> 8 & 0xFF).astype(np.int64).reshape(height, -1)
    if pack:
        each = 8 >> pack
        index = (index[:, :, None] >> (np.arange(1 << pack) * each) & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    colours = np.concatenate([colours, np.zeros(256, np.uint32)])
    return colours[index.ravel()]


def decode_many(chunks: list[bytes]) -> list[np.ndarray]:
    """The pixels of VP8L chunks, each of shape (height, width)."""
    files = read_files(chunks)
    images = [f.image for f in files]
    for kind in (False, True):  # those of nothing but literals take fewer steps for a pixel
        if some := [x for x in images if x.special == kind]:
            decode_lanes(some)
    now = [f.image.pixels for f in files]
    depth = max((len(f.transforms) for f in files), default=0)
    for back in range(1, depth + 1):
        waiting = []
        for i, f in enumerate(files):
            if len(f.transforms) < back:
                continue
            kind, width, *rest = f.transforms[-back]
            if kind == PREDICTOR:
                waiting.append((i, (now[i], width, *rest)))
            elif kind == CROSS_COLOUR:
                now[i] = cross_colour(now[i], width, *rest)
            elif kind == SUBTRACT_GREEN:
                green = now[i] >> np.uint32(8) & np.uint32(0xFF)
                now[i] = add(now[i], green | green << np.uint32(16))
            else:
                now[i] = unpack(now[i], width, f.height, *rest)
        for (i, _), pixels in zip(waiting, undo_predictor([x for _, x in waiting]) if waiting else []):
            now[i] = pixels
    return [p.reshape(f.height, f.width) for p, f in zip(now, files)]


def chunks_of(data: bytes) -> list[tuple[int, int, bytes]]:
    """x, y and VP8L chunk of a file's picture or of each of its frames."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    found, at = [], 12
    end = min(len(data), 8 + struct.unpack("<I", data[4:8])[0])
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"VP8L":
            found.append((0, 0, body))
        elif kind == b"ANMF":
            inner, x, y = 16, int.from_bytes(body[:3], "little") * 2, int.from_bytes(body[3:6], "little") * 2
            while inner + 8 <= len(body):
                n = struct.unpack("<I", body[inner + 4 : inner + 8])[0]
                if body[inner : inner + 4] == b"VP8L":
                    found.append((x, y, body[inner + 8 : inner + 8 + n]))
                inner += 8 + n + (n & 1)
        at += 8 + size + (size & 1)
    if not found:
        raise ValueError("a WebP file without lossless data")
    return found


def pictures(datas: list[bytes]) -> list[np.ndarray]:
    """The pixel array of each file; frames of an animation stand at their places on one canvas."""
    parts = [chunks_of(d) for d in datas]
    pixels = iter(decode_many([c for p in parts for _, _, c in p]))
    out = []
    for part in parts:
        own = [(x, y, next(pixels)) for x, y, _ in part]
        if len(own) == 1 and not own[0][0] and not own[0][1]:
            out.append(own[0][2])
            continue
        canvas = np.zeros((max(y + p.shape[0] for _, y, p in own), max(x + p.shape[1] for x, _, p in own)), np.uint32)
        for x, y, p in own:
            canvas[y : y + p.shape[0], x : x + p.shape[1]] = p
        out.append(canvas)
    return out


# Writing


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of a prefix code for symbols with counts over 0, none longer than most: of a Huffman code, with rare
    symbols counted up until it is flat enough."""
    lengths = [0] * len(counts)
    used = [i for i, c in enumerate(counts) if c]
    if len(used) < 2:
        for i in used:
            lengths[i] = 1
        return lengths
    floor = 1
    while True:
        heap = [(max(counts[i], floor), i) for i in used]
        heapq.heapify(heap)
        parent, new = {}, len(counts)
        while len(heap) > 1:
            a, x = heapq.heappop(heap)
            b, y = heap[0]
            parent[x] = parent[y] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = {new - 1: 0}
        for node in range(new - 2, len(counts) - 1, -1):
            depth[node] = depth[parent[node]] + 1
        for i in used:
            lengths[i] = depth[parent[i]] + 1
        if max(lengths) <= most:
            return lengths
        floor = floor * 2 if floor > 1 else max(2, sum(counts) >> (most + 1))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The bits of each symbol's code, first bit lowest."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return codes
    order = used[np.argsort(lengths[used], kind="stable")]
    size, most = lengths[order].astype(np.int64), int(lengths.max())
    first = np.r_[0, np.cumsum(1 << (most - size))[:-1]] >> (most - size)
    codes[order] = reversed_bits(most)[first << (most - size)]
    return codes


def short_codes(lengths: list[int]) -> list[int]:
    """canonical() for a few symbols."""
    codes, code = [0] * len(lengths), 0
    for n in range(1, max(lengths) + 1):
        code <<= 1
        for i, x in enumerate(lengths):
            if x == n:
                codes[i] = int(f"{code:0{n}b}"[::-1], 2)
                code += 1
    return codes


def canonical_rows(lengths: np.ndarray, most: int) -> np.ndarray:
    """canonical() of each row; most: the largest length that there may be."""
    codes = np.zeros(lengths.shape, np.uint64)
    row, symbol = np.nonzero(lengths)
    size = lengths[row, symbol].astype(np.int64)
    order = np.lexsort((symbol, size, row))
    row, symbol, size = row[order], symbol[order], size[order]
    share = 1 << (most - size)
    before = np.cumsum(share) - share
    begin = np.searchsorted(row, np.arange(len(lengths)))
    before -= before[begin[row]]
    codes[row, symbol] = reversed_bits(most)[before]
    return codes


class Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def data(self) -> bytes:
        return self.value.to_bytes((self.n + 7) >> 3, "little")


def put_lengths(out: Writer, lengths: list[int]) -> None:
    """A prefix code's lengths; zeros at the end are left out."""
    used = [i for i, x in enumerate(lengths) if x]
    if len(used) < 2 and (not used or used[0] < 256):
        symbol = used[0] if used else 0
        out.put(1, 1), out.put(0, 1), out.put(1, 1), out.put(symbol, 8)
        return
    tokens, at, end = [], 0, used[-1] + 1
    while at < end:
        x, n = lengths[at], 1
        if not x:
            while n < 138 and at + n < end and not lengths[at + n]:
                n += 1
            if n >= 11:
                tokens.append((18, n - 11, 7))
            elif n >= 3:
                tokens.append((17, n - 3, 3))
            else:
                tokens += [(0, 0, 0)] * n
        else:
            tokens.append((x, 0, 0))
        at += n
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    own = code_lengths(counts, 7)
    codes = short_codes(own)
    alone = sum(x > 0 for x in own) < 2
    shown = max(4, max(i for i, k in enumerate(CODE_LENGTH_ORDER) if own[k]) + 1)
    out.put(0, 1), out.put(shown - 4, 4)
    for k in CODE_LENGTH_ORDER[:shown]:
        out.put(own[k], 3)
    width = next(w for w in range(2, 17, 2) if max(len(tokens), 2) - 2 < 1 << w)
    out.put(1, 1), out.put((width - 2) // 2, 3), out.put(max(len(tokens), 2) - 2, width)
    tokens += [(tokens[-1][0], 0, 0)] * (2 - len(tokens))
    for t, extra, n in tokens:
        if not alone:
            out.put(codes[t], own[t])
        if n:
            out.put(extra, n)


def prefix_of(value: int) -> tuple[int, int, int]:
    """Prefix code, extra bits and their number for a length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    n = top - 1
    return 2 * top + (v >> n & 1), v & ((1 << n) - 1), n


def put_image(out: Writer, pixels: np.ndarray, cache_bits: int = 0, references: bool = False, whole: bool = False, groups: tuple[int, np.ndarray, int] | None = None) -> None:
    """An entropy-coded image, pixel by pixel; groups: block bits, the group of each block, and the width."""
    flat = pixels.ravel().tolist()
    cache = [0] * (1 << cache_bits) if cache_bits else []
    symbols = []  # at, green or length code, the rest
    at, latest = 0, {}
    while at < len(flat):
        p, n, dist = flat[at], 0, 0
        if references and at and at + 2 < len(flat):
            key = tuple(flat[at : at + 3])
            if (before := latest.get(key)) is not None:
                dist = at - before
                while n < 4096 and at + n < len(flat) and flat[at + n] == flat[at + n - dist]:
                    n += 1
        if n >= 3:
            symbols.append((at, LITERALS + prefix_of(n)[0], (n, dist + 120)))
        elif cache_bits and cache[slot := (p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] == p:
            symbols.append((at, LITERALS + LENGTH_CODES + slot, None))
            n = 1
        else:
            symbols.append((at, p >> 8 & 255, p))
            n = 1
        for i in range(at, at + n):
            if cache_bits:
                cache[(flat[i] * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = flat[i]
            if i + 2 < len(flat):
                latest[tuple(flat[i : i + 3])] = i
        at += n
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    of = lambda at: 0
    n_groups = 1
    if whole:
        out.put(int(groups is not None), 1)
        if groups:
            bits, values, width = groups
            out.put(bits - 2, 3)
            put_image(out, (values.astype(np.uint32) << np.uint32(8)))
            n_groups = int(values.max()) + 1
            across = -(-width >> bits)
            of = lambda at: int(values[(at // width >> bits) * across + (at % width >> bits)])
    sizes = (LITERALS + LENGTH_CODES + len(cache), 256, 256, 256, DISTANCES)
    counts = [[[0] * k for k in sizes] for _ in range(n_groups)]
    for at, s, rest in symbols:
        c = counts[of(at)]
        c[0][s] += 1
        if s < LITERALS:
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                c[k][rest >> shift & 255] += 1
        elif isinstance(rest, tuple):
            c[4][prefix_of(rest[1])[0]] += 1
    codes = []
    for group in counts:
        codes.append([])
        for c in group:
            lengths = code_lengths(c, 15)
            if sum(x > 0 for x in lengths) == 1 and lengths.index(1) > 255:
                lengths[0] = 1  # a simple code holds 8 bits of a symbol
            put_lengths(out, lengths)
            alone = sum(x > 0 for x in lengths) < 2
            codes[-1].append((canonical(np.array(lengths)).tolist(), [0] * len(lengths) if alone else lengths))
    for at, s, rest in symbols:
        own = codes[of(at)]
        out.put(own[0][0][s], own[0][1][s])
        if s < LITERALS:
            for k, shift in ((1, 16), (2, 0), (3, 24)):
                v = rest >> shift & 255
                out.put(own[k][0][v], own[k][1][v])
        elif isinstance(rest, tuple):
            out.put(*prefix_of(rest[0])[1:])
            k, extra, n = prefix_of(rest[1])
            out.put(own[4][0][k], own[4][1][k])
            out.put(extra, n)


def put_head(out: Writer, width: int, height: int) -> None:
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(1, 1), out.put(0, 3)


#: Predictors that the writer tries, bits of a block that holds a whole strip, and the largest cache it uses.
TRIED = (1, 2, 11)
WHOLE = 9
MOST_CACHE = 9
#: By what share literals must be longer than references or a cache, which take longer to read.
WORTH = 0.06


def bits_of(counts: np.ndarray) -> np.ndarray:
    """About how many bits the symbols counted in each row take, with the lengths of their code."""
    n = counts.sum(1)
    c = np.maximum(counts, 1)
    return n * np.log2(np.maximum(n, 1)) - (counts * np.log2(c)).sum(1) + 4.5 * np.count_nonzero(counts, axis=1) + 40


def counted(strip: np.ndarray, symbols: np.ndarray, n: int, size: int) -> np.ndarray:
    return np.bincount((strip * size + symbols).ravel(), minlength=n * size).reshape(n, size)


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix codes, extra bits and their numbers for lengths or distance codes."""
    v = values - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1] - 1
    n = np.where(v < 4, 0, top - 1)
    return np.where(v < 4, v, 2 * top + (v >> np.maximum(n, 0) & 1)), np.where(v < 4, 0, v & ((1 << n) - 1)), n


class Strips:
    """Pixels of many strips, one after the other; size: how many each has."""

    def __init__(self, pixels: np.ndarray, size: np.ndarray, width: int):
        self.pixels, self.size, self.width = pixels, size, width
        self.start = np.cumsum(np.r_[0, size])
        self.strip = np.repeat(np.arange(len(size)), size)
        self.at = np.arange(len(pixels)) - self.start[self.strip]

    def residuals(self, mode: int) -> np.ndarray:
        p = np.concatenate([np.zeros(self.width + 1, np.uint32), self.pixels])
        n, w = len(self.pixels), self.width
        left, top, corner, right = p[w : w + n], p[1 : 1 + n], p[:n], p[2 : 2 + n]
        guess = np.where(self.at < w, left, np.where(self.at % w == 0, top, predicted(mode, left, top, corner, right)))
        guess[self.at == 0] = 0xFF000000
        return (self.pixels.view(np.uint8) - guess.view(np.uint8)).view(np.uint32)

    def multipliers(self) -> np.ndarray:
        """Cross-colour values: what share of green makes red and blue most alike by least squares, by strip."""
        c = channels(self.pixels)
        green = signed(c[:, 1])
        add_up = lambda x: np.add.reduceat(x, self.start[:-1]).astype(np.float64)
        n, g = self.size, add_up(green)
        spread = np.maximum(n * add_up(green * green) - g * g, 1)
        share = [np.clip(np.rint(32 * (n * add_up(green * signed(c[:, k])) - g * add_up(signed(c[:, k]))) / spread), -128, 127).astype(np.int64) & 255 for k in (2, 0)]
        return (0xFF000000 | share[1] << 8 | share[0]).astype(np.uint32)

    def palettes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By strip, the bits that a palette and its indexes would take (infinite over 256 colours); the sorted
        distinct (strip << 32 | colour); where each strip's begin."""
        keys = np.sort(self.strip.astype(np.uint64) << np.uint64(32) | self.pixels)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        times = np.diff(np.r_[first, len(keys)])
        keys = keys[first]
        begin = np.searchsorted(keys, np.arange(len(self.size) + 1).astype(np.uint64) << np.uint64(32))
        colours = np.diff(begin)
        cost = self.size * np.log2(self.size) - np.add.reduceat(times * np.log2(times), begin[:-1]) + colours * (4.5 + 28) + 300
        return np.where(colours <= 256, cost, np.inf), keys, begin

    def copies(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, length and distance of back-references, in order, that don't overlap: a run of places whose next
        three pixels last stood equally far back is one."""
        p, n = self.pixels, len(self.pixels)
        if n < 4:
            return (np.zeros(0, np.int64),) * 3
        three = p[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        three = (three ^ p[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)
        three = ((three ^ p[2:]) * np.uint64(0x94D049BB133111EB)) >> np.uint64(24) ^ self.strip[:-2].astype(np.uint64) << np.uint64(40)
        order = np.argsort(three, kind="stable")
        a, b = order[:-1], order[1:]
        same = three[a] == three[b]
        a, b = a[same], b[same]
        for k in range(3):
            ok = (p[a + k] == p[b + k]) & (self.strip[a + k] == self.strip[b + k]) & (self.strip[b] == self.strip[b + k])
            a, b = a[ok], b[ok]
        back = np.zeros(n, np.int64)
        back[b] = b - a
        edge = np.flatnonzero(np.r_[True, (back[1:] != back[:-1]) | (self.strip[1:] != self.strip[:-1])])
        stop = np.r_[edge[1:], n]
        edge, stop = edge[back[edge] > 0], stop[back[edge] > 0] + 2
        begin = np.maximum(edge, np.r_[0, stop[:-1]])
        ok = stop - begin >= 3
        return begin[ok], (stop - begin)[ok], back[edge[ok]]

    def hits(self, cache_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each pixel's slot in the colour cache, and whether it is there."""
        slot = ((self.pixels * np.uint32(CACHE_FACTOR)) >> (32 - cache_bits[self.strip]).astype(np.uint32)).astype(np.int64)
        key = (self.strip << MOST_CACHE | slot).astype(np.uint32 if len(self.size) < 1 << (32 - MOST_CACHE) else np.int64)
        order = np.argsort(key, kind="stable")
        a, b = order[:-1], order[1:]
        hit = np.zeros(len(self.pixels), bool)
        hit[b] = (key[a] == key[b]) & (self.pixels[a] == self.pixels[b])
        return slot, hit


def transformed(strips: Strips) -> tuple[Strips, list[tuple], np.ndarray]:
    """The strips after the transform that makes each smallest, if any: pixels, (kind, values) or () for each strip,
    and which have a palette."""
    n, base = len(strips.size), np.repeat(strips.strip, 4)
    cost = lambda p: bits_of(counted(base, p.view(np.uint8), n, 256))
    least, kinds, best = cost(strips.pixels), [()] * n, strips.pixels

    def offer(pixels: np.ndarray, extra: int, kind) -> None:
        nonlocal best
        now = cost(pixels) + extra
        won = now < least
        if won.any():
            least[won] = now[won]
            best = np.where(won[strips.strip], pixels, best)
            for i in np.flatnonzero(won):
                kinds[i] = kind(i)

    green = strips.pixels >> np.uint32(8) & np.uint32(0xFF)
    offer((strips.pixels.view(np.uint8) - (green | green << np.uint32(16)).view(np.uint8)).view(np.uint32), 3, lambda i: (SUBTRACT_GREEN, None))
    values = strips.multipliers()
    offer(crossed(strips.pixels, values[strips.strip], undo=False), 80, lambda i: (CROSS_COLOUR, values[i : i + 1]))
    for mode in TRIED:
        offer(strips.residuals(mode), 70, lambda i, m=mode: (PREDICTOR, np.array([0xFF000000 | m << 8], np.uint32)))
    size, keys, begin = strips.palettes()
    few = np.flatnonzero(size < least)
    if not len(few):
        return Strips(best, strips.size, strips.width), kinds, np.zeros(n, bool)
    pieces = np.split(best, strips.start[1:-1])
    for i in few:
        colours = (keys[begin[i] : begin[i + 1]] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        index = np.searchsorted(colours, strips.pixels[strips.start[i] : strips.start[i + 1]]).reshape(-1, strips.width)
        pack = pack_of(len(colours))
        index = np.pad(index, ((0, 0), (0, -strips.width % (1 << pack))))
        index = (index.reshape(len(index), -1, 1 << pack) << (np.arange(1 << pack) * (8 >> pack))).sum(2)
        pieces[i], kinds[i] = (index.ravel() << 8 | 0xFF000000).astype(np.uint32), (PALETTE, colours)
    return Strips(np.concatenate(pieces), np.array([len(p) for p in pieces]), strips.width), kinds, np.isin(np.arange(n), few)


def put_transform(out: Writer, kind: int, values: np.ndarray | None) -> None:
    out.put(1, 1), out.put(kind, 2)
    if kind == PALETTE:
        out.put(len(values) - 1, 8)
        c = channels(values)
        values = joined(np.r_[c[:1], np.diff(c, axis=0) & 255])
    elif kind != SUBTRACT_GREEN:
        out.put(WHOLE - 2, 3)
    if values is not None:
        put_image(out, values)


def encode_strips(samples: np.ndarray, rows: list[int], width: int = 16, most: int = 12) -> list[bytes]:
    """VP8L chunks of strips that lie one after the other in samples (red, green, blue, alpha of each pixel), strip i
    of rows[i] lines, all strips at once. Each strip gets the transform, the colour cache and the back-references that
    make it smallest, by its counts of symbols. Red, blue and alpha share a prefix code, in a strip of nothing but
    literals green as well; with a palette only green has one."""
    n = len(rows)
    pixels = np.ascontiguousarray(samples.reshape(-1, 4)[:, [2, 1, 0, 3]]).view(np.uint32).ravel()
    s, kinds, indexed = transformed(Strips(pixels, np.array(rows, np.int64) * width, width))
    quads = s.pixels.view(np.uint8).reshape(-1, 4)  # blue, green, red, alpha
    cache_bits = np.clip(np.frexp(s.size.astype(np.float64))[1] - 2, 4, MOST_CACHE).astype(np.int64)
    begin, length, back = s.copies()
    slot, hit = s.hits(cache_bits)
    edge = np.zeros(len(s.pixels) + 1, np.int64)
    edge[begin] += 1
    edge[begin + length] -= 1
    inside = np.cumsum(edge[:-1]) > 0
    head = np.zeros(len(s.pixels), bool)
    head[begin] = True
    code, code_extra, code_n = prefixes(length)
    far, far_extra, far_n = prefixes(back + 120)
    green = quads[:, 1].astype(np.int64)
    copy_code = np.zeros(len(s.pixels), np.int64)
    copy_code[begin] = LITERALS + code
    size = LITERALS + LENGTH_CODES + (1 << MOST_CACHE)

    def tables(copied: np.ndarray, cached: np.ndarray) -> tuple:
        """Counts of green, other and distance codes if pixels marked in copied and cached are such, and which pixels
        begin a symbol, which are literals, and the symbols in green's code."""
        literal = ~(copied | cached)
        symbol = np.where(copied, copy_code, np.where(cached, LITERALS + LENGTH_CODES + slot, green))
        starts = ~copied | head
        rest = literal & ~indexed[s.strip]
        own = counted(s.strip[starts], symbol[starts], n, size)
        others = counted(s.strip[rest][:, None], quads[rest][:, [0, 2, 3]], n, 256)
        kept = copied[begin]
        return own, others, counted(s.strip[begin[kept]], far[kept], n, DISTANCES), starts, literal, symbol

    extra_bits = np.bincount(s.strip[begin], code_n + far_n, n)
    none = np.zeros(len(s.pixels), bool)
    own, others, _, *_ = tables(none, none)
    alike = own[:, :256] + others
    choices = [np.where(indexed, bits_of(own) + 40, bits_of(alike) + 3 * (4.5 * np.count_nonzero(alike, axis=1) + 40))]
    for copied, cached in ((inside, none), (none, hit), (inside, hit & ~inside)):
        own, others, away, *_ = tables(copied, cached)
        headers = 2 * (4.5 * np.count_nonzero(others, axis=1) + 40)
        choices.append(bits_of(own) + np.where(indexed, 0, bits_of(others) + headers) + (bits_of(away) + extra_bits if copied is inside else 0))
    choices = np.stack(choices)
    choices[1:] *= 1 + WORTH
    choice = np.argmin(choices, axis=0)
    references, cache = (choice & 1) > 0, choice > 1
    copied = inside & references[s.strip]
    cached = hit & cache[s.strip] & ~copied
    own, others, away, starts, literal, symbol = tables(copied, cached)
    plain = (choice == 0) & ~indexed
    own[plain, :256] += others[plain]

    heads, lens = [], [np.zeros(c.shape, np.uint64) for c in (own, others, away)]
    for i in range(n):
        out = Writer()
        put_head(out, width, rows[i])
        if kinds[i]:
            put_transform(out, *kinds[i])
        out.put(0, 1)
        out.put(int(cache[i]), 1)
        if cache[i]:
            out.put(int(cache_bits[i]), 4)
        out.put(0, 1)  # one group
        written = []
        for c, to in zip((own, others, away), lens):
            if plain[i] and to is lens[1]:
                written.append(written[0])
                to[i] = lens[0][i, :256]
                continue
            used = np.flatnonzero(c[i])
            piece = Writer()
            written.append(piece)
            if not len(used):
                put_lengths(piece, [])
                continue
            now = np.zeros(int(used[-1]) + 1, np.uint64)
            now[used] = code_lengths(c[i, used].tolist(), most)
            put_lengths(piece, now.tolist())
            if len(used) > 1:
                to[i, : len(now)] = now
        out.put(written[0].value, written[0].n)
        if indexed[i]:
            for k in (0, 0, 255):
                put_lengths(out, [0] * k + [1])
        else:
            for _ in range(3):
                out.put(written[1].value, written[1].n)
        out.put(written[2].value, written[2].n)
        heads.append(out)

    found = [(canonical_rows(x, most), x) for x in lens]
    value, bits = np.zeros(len(s.pixels), np.uint64), np.zeros(len(s.pixels), np.uint64)

    def put(places: np.ndarray, what: np.ndarray, how_many: np.ndarray) -> None:
        value[places] |= what.astype(np.uint64) << bits[places]
        bits[places] += how_many.astype(np.uint64)

    def put_code(places: np.ndarray, k: int, symbols: np.ndarray) -> None:
        at = s.strip[places] * found[k][0].shape[1] + symbols
        put(places, found[k][0].ravel()[at], found[k][1].ravel()[at])

    token = np.flatnonzero(starts)
    put_code(token, 0, symbol[token])
    full = np.flatnonzero(literal & ~indexed[s.strip])
    for c in (2, 0, 3):
        put_code(full, 1, quads[full, c])
    kept = copied[begin]
    put(begin[kept], code_extra[kept], code_n[kept])
    put_code(begin[kept], 2, far[kept])
    put(begin[kept], far_extra[kept], far_n[kept])
    return joined_bits(value[token], bits[token].astype(np.int64), np.bincount(s.strip[token], minlength=n), heads)


def joined_bits(value: np.ndarray, size: np.ndarray, sizes: np.ndarray, heads: list[Writer]) -> list[bytes]:
    """For each head its bits and those of its next sizes[i] values, of size bits each, 64 at most."""
    stop = np.cumsum(size)
    first = np.cumsum(np.r_[0, sizes])[:-1]
    before = np.r_[0, stop][first]
    total = np.r_[stop[first[1:] - 1], stop[-1:]] - before + np.array([h.n for h in heads])
    words = (total + 63 >> 6) + 1
    word_at = np.cumsum(np.r_[0, words])
    place = stop - size - np.repeat(before - np.array([h.n for h in heads]) - word_at[:-1] * 64, sizes)
    buffer = np.zeros(word_at[-1] + 1, np.uint64)
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    buffer[word[starts]] |= np.bitwise_or.reduceat(value << shift, starts)
    over = np.flatnonzero((place & 63) + size > 64)
    buffer[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    raw = buffer.view(np.uint8)
    out = []
    for i, h in enumerate(heads):
        lead = np.frombuffer(h.data(), np.uint8)
        at = word_at[i] * 8
        raw[at : at + len(lead)] |= lead
        out.append(raw[at : at + ((int(total[i]) + 7) >> 3)].tobytes())
    return out


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def riff(body: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body


def file_of(strips: list[tuple[int, bytes]], width: int) -> bytes:
    """A file of strips (lines, VP8L chunk), one below the other: one picture, or frames of an animation."""
    if len(strips) == 1:
        return riff(chunk(b"VP8L", strips[0][1]))
    three = lambda n: n.to_bytes(3, "little")
    height = sum(n for n, _ in strips)
    body = [chunk(b"VP8X", bytes([0x12, 0, 0, 0]) + three(width - 1) + three(height - 1)), chunk(b"ANIM", bytes(6))]
    y = 0
    for n, data in strips:
        body.append(chunk(b"ANMF", three(0) + three(y // 2) + three(width - 1) + three(n - 1) + three(0) + b"\2" + chunk(b"VP8L", data)))
        y += n
    return riff(b"".join(body))
