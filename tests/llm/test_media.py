import math
import random
import zlib

import numpy as np
import pytest

from tidemill.llm import media, webp


def file(pixels, transforms=(), **how):
    """A VP8L chunk of pixels after the given transforms, each (kind, block bits or None, values)."""
    height, width = pixels.shape
    out = webp.Writer()
    webp.put_head(out, width, height)
    now, w = pixels.ravel().astype(np.uint32), width
    for kind, bits, values in transforms:
        out.put(1, 1), out.put(kind, 2)
        if kind == webp.PREDICTOR:
            out.put(bits - 2, 3)
            webp.put_image(out, values)
            rest = now.copy()
            for i in range(len(now)):
                y, x = divmod(i, w)
                m = int(values[(y >> bits) * -(-w >> bits) + (x >> bits)]) >> 8 & 15
                m = (1 if x else 0) if not y else m if x else 2
                at = lambda k: now[k : k + 1] if k >= 0 else np.zeros(1, np.uint32)
                guess = webp.predicted(m, at(i - 1), at(i - w), at(i - w - 1), at(i - w + 1))
                rest[i] = sum((((int(now[i]) >> s) - (int(guess[0]) >> s)) & 255) << s for s in (0, 8, 16, 24))
            now = rest
        elif kind == webp.CROSS_COLOUR:
            out.put(bits - 2, 3)
            webp.put_image(out, values)
            now = webp.cross_colour(now, w, bits, values, undo=False)
        elif kind == webp.SUBTRACT_GREEN:
            c = webp.channels(now)
            c[:, 0], c[:, 2] = (c[:, 0] - c[:, 1]) & 255, (c[:, 2] - c[:, 1]) & 255
            now = webp.joined(c)
        else:
            out.put(len(values) - 1, 8)
            c = webp.channels(values)
            webp.put_image(out, webp.joined(np.r_[c[:1], np.diff(c, axis=0) & 255]))
            pack = 3 if len(values) <= 2 else 2 if len(values) <= 4 else 1 if len(values) <= 16 else 0
            index = np.array([values.tolist().index(p) for p in now.tolist()]).reshape(height, w)
            w2 = -(-w >> pack)
            full = np.zeros((height, w2 << pack), np.int64)
            full[:, :w] = index
            packed = (full.reshape(height, w2, -1) << (np.arange(1 << pack) * (8 >> pack))).sum(2)
            now, w = (packed.ravel() << 8 | 0xFF000000).astype(np.uint32), w2
    out.put(0, 1)
    webp.put_image(out, now, whole=True, **how)
    return out.data()


def picture(seed, height=13, width=11, colours=None):
    r = np.random.default_rng(seed)
    if colours is not None:
        return r.choice(np.array(colours, np.uint32), (height, width))
    smooth = np.cumsum(r.integers(-3, 4, (height, width, 4)), axis=1) + 128
    return np.ascontiguousarray(smooth.astype(np.uint8)).view(np.uint32)[:, :, 0]


def modes(kinds, bits, height, width):
    n = -(-height >> bits) * -(-width >> bits)
    return np.array([(kinds[i % len(kinds)] << 8) | 0xFF000000 for i in range(n)], np.uint32)


CASES = {
    "plain": lambda p: {},
    "cache": lambda p: {"cache_bits": 4},
    "references": lambda p: {"references": True},
    "all": lambda p: {"cache_bits": 7, "references": True, "groups": (2, np.array([i % 3 for i in range(12)]), 11)},
}


@pytest.mark.parametrize("how", CASES)
@pytest.mark.parametrize("seed", range(3))
def test_codes_references_and_cache(how, seed):
    p = picture(seed) if seed else picture(seed, colours=[1, 2, 3 << 24, 0xFFFFFFFF])
    assert (webp.decode_many([file(p, **CASES[how](p))])[0] == p).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    p = picture(mode)
    assert (webp.decode_many([file(p, [(webp.PREDICTOR, 2, modes([mode, (mode + 5) % 14], 2, *p.shape))], references=True)])[0] == p).all()


def test_cross_colour_and_green():
    p = picture(5)
    values = np.random.default_rng(1).integers(0, 1 << 24, 12).astype(np.uint32) | np.uint32(0xFF000000)
    steps = [(webp.PREDICTOR, 2, modes([11, 12, 13], 2, *p.shape)), (webp.CROSS_COLOUR, 2, values), (webp.SUBTRACT_GREEN, None, None)]
    assert (webp.decode_many([file(p, steps)])[0] == p).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(n):
    colours = np.random.default_rng(n).integers(0, 1 << 32, n).astype(np.uint32)
    p = picture(n, colours=colours)
    assert (webp.decode_many([file(p, [(webp.PALETTE, None, colours)], cache_bits=3, references=True)])[0] == p).all()


def test_many_pictures_at_once():
    ps = [picture(s, 3 + s, 5 + s % 4) for s in range(9)]
    files = [file(p, [(webp.SUBTRACT_GREEN, None, None)][: s % 2], references=s % 3 == 0, cache_bits=s % 4) for s, p in enumerate(ps)]
    assert all((a == b).all() for a, b in zip(webp.decode_many(files), ps))


def test_short_distances():
    assert webp.near()[:8].tolist() == [[0, 1], [1, 0], [1, 1], [-1, 1], [0, 2], [2, 0], [1, 2], [-1, 2]]
    assert len(webp.near()) == 120 and webp.near()[-1].tolist() == [8, 7]


def test_broken_data():
    with pytest.raises(ValueError):
        webp.pictures([b"RIFFxxxx"])
    with pytest.raises(ValueError):
        webp.decode_many([file(picture(1))[:-40]])


def test_payloads():
    random.seed(3)
    payloads = [media.padded(x) for x in (b"", b"a", b"abc" * 40, random.randbytes(70_000), b"\0" * 40_000, bytes(range(256)) * 3, b"x" * 64)]
    files = media.store(payloads)
    assert [s.tobytes() for s in media.load(files)] == payloads
    assert len(payloads[0]) == 64


def test_digests(spark):
    rows = [(1, "abc", "x"), (2, None, None), (3, "", "y"), (4, "é" * 30_000, "z"), (None, "abc", "x"), (1, "abc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    out = {(r.doc_id, r.n_bytes): r for r in media.digests(df).collect()}
    assert out[1, 3].payload_sha256 == out[None, 3].payload_sha256 == media.sha(b"abc" + bytes(61))
    assert out[2, 0].media_sha256 == out[3, 0].media_sha256 and out[2, 0].payload_bytes == 64
    for i, text in ((1, "abc"), (2, ""), (3, ""), (4, "é" * 30_000), (None, "abc")):
        payload = media.padded(text.encode())
        (file,) = media.store([payload])
        r = out[i, len(text.encode())]
        assert (r.payload_bytes, r.tail_crc32) == (len(payload), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), media.sha(file))
    assert out[4, 60_000].payload_bytes == 60_032
    back = media.read(media.write(df)).where("doc_id = 4").first()
    assert bytes(back.samples) == ("é" * 30_000).encode() + bytes(32)
    assert media.digests(df.limit(0)).count() == 0


def kinds_of(payload):
    """What the stored strips of a payload use."""
    found = set()
    for _, _, c in webp.chunks_of(media.store([payload])[0]):
        (f,) = webp.read_files([c])
        found |= {("transform", t[0]) for t in f.transforms}
        found |= {"cache"} if f.image.cache_bits else set()
        found |= {"references"} if any((g[0] >> 4 >= webp.LITERALS).any() and (g[4] > 0).any() for g in f.image.codes) else set()
        found |= {"literals"} if not f.image.special else set()
    return found


def varied():
    """Payloads of one kind each, made of what texts hold, and the part of the format that suits it."""
    r = np.random.default_rng(5)
    words = [bytes(r.integers(97, 123, 4, np.uint8)) for _ in range(40)]
    line = bytes(r.integers(33, 127, 64, np.uint8))
    g = r.integers(32, 64, 8000)
    flat = lambda *c: np.stack(c, 1).astype(np.uint8).tobytes()
    grown = np.cumsum(r.integers(0, 2, (300, 64)), axis=0) % 90 + 33
    return {
        "literals": r.integers(33, 127, 8192, np.uint8).tobytes(),
        "references": b"".join(bytes(r.integers(33, 127, 200, np.uint8)) * 2 for _ in range(30)),
        "cache": b"".join(words[i] if i < 40 else bytes(r.integers(33, 127, 4, np.uint8)) for i in r.integers(0, 50, 4000)),
        ("transform", webp.PALETTE): b"".join(words[i] for i in r.integers(0, 6, 3000)),
        ("transform", webp.SUBTRACT_GREEN): flat(g + r.integers(0, 2, 8000), g, g + r.integers(0, 2, 8000), r.integers(33, 64, 8000)),
        ("transform", webp.CROSS_COLOUR): flat(2 * g + r.integers(0, 2, 8000), g, 3 * g // 2 + r.integers(0, 2, 8000), r.integers(0, 3, 8000)),
        ("transform", webp.PREDICTOR): grown.astype(np.uint8).tobytes() + line,
    }


@pytest.mark.parametrize("kind", varied(), ids=str)
def test_stored_form_suits_content(kind):
    payload = media.padded(varied()[kind])
    assert kind in kinds_of(payload)
    assert media.load(media.store([payload]))[0].tobytes() == payload


def test_digests_against_plain_version():
    r = random.Random(8)
    for data in (b"", b"a" * 64, bytes(r.choices(range(32, 127), k=5000)), "héllo wörld ".encode() * 900):
        payload = media.padded(data)
        (samples,) = media.load(media.store([payload]))
        n, total = len(payload), sum(payload)
        spread = int(math.sqrt(sum((n * x - total) ** 2 for x in payload) / n) * 1000) // n
        part = n // 64
        bits = "".join("1" if sum(payload[k * part : (k + 1) * part]) * 64 > total else "0" for k in range(64))
        got = dict(x.split("=") for x in media.features(samples).split(" "))
        assert abs(int(got.pop("deviation")) - spread) <= 1
        assert got == {"mean": str(total * 1000 // n), "values": str(len(set(payload))), "hash": f"{int(bits, 2):016x}"}


@pytest.mark.parametrize("seed", range(30))
def test_any_bytes_come_back(seed, monkeypatch):
    monkeypatch.setattr(media, "WRITTEN", 4096)
    r = random.Random(seed)
    payloads = []
    for _ in range(20):
        alphabet = r.sample(range(256), r.choice([1, 2, 3, 5, 17, 60, 256]))
        data = bytearray(r.choices(alphabet, k=r.choice([1, 64, 500, 3000, 20_000])))
        for _ in range(r.randrange(6)):
            a, b, n = (r.randrange(len(data)) for _ in range(3))
            data[a : a + n] = data[b : b + n]
        payloads.append(media.padded(bytes(data)))
    files = media.store(payloads)
    assert [s.tobytes() for s in media.load(files)] == payloads
    assert media.store(payloads[7:8]) == files[7:8]
