import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemill.llm import bpe, packing
from tidemill.llm.queries import WORD_BPE

TEXTS = [
    "", " \n\t", "plain words, and more words.", "a <|endoftext|>b <|ENDOFTEXT|>c<|startoftext|><|endof", "İstanbul ΑΣ ΟΔΟΣ ﬁ Σ, it's x'Re I'LL we'd'S ''''s",
    "\x1c\x1d a\x1fb\x85c d　e", "é́é ² ½ x² 世界 𝟘 ٣٤ 🙂🙂👩‍👩‍👧", "aaaa" * 200, "1234567890 3.14,15", "word." * 300, "Å Å ǅ ß ẞ İ K", "x" * 30_000, "?!...,, - –—",
]


def texts():
    rnd = random.Random(8)
    letters = "abcdeéüñ .,'!1 \nÀΣ世"
    return TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(300))) for _ in range(200)]


def test_against_the_library():
    library, own = Tokenizer.from_file(WORD_BPE), bpe.WordBpe(WORD_BPE, cache_entries=50)
    for _ in range(2):
        for t, x in zip(texts(), own.encode(texts())):
            ids = np.frombuffer(x, "<u4").tolist()
            assert ids == library.encode(t, add_special_tokens=False).ids, t
            assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_code_point():
    library, own = Tokenizer.from_file(WORD_BPE), bpe.WordBpe(WORD_BPE)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 1 << 16):
        lots = [every[k : k + 32] for k in range(i, min(i + (1 << 16), len(every)), 32)]
        said = [" ".join(f"a{c}," for c in lot) for lot in lots]
        for lot, x, y in zip(lots, own.encode(said), library.encode_batch(said, add_special_tokens=False)):
            assert np.frombuffer(x, "<u4").tolist() == y.ids, ascii(lot)


def test_marks_in_all_orders():
    """Every mark, and every character with parts, between marks of lower and higher classes; then many together."""
    library, own = Tokenizer.from_file(WORD_BPE), bpe.WordBpe(WORD_BPE)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    marks = [c for c in every if unicodedata.combining(c)]
    parts = [unicodedata.normalize("NFD", c) for c in every if unicodedata.decomposition(c) and not 0xAC00 <= ord(c) < 0xD7A4]
    around = [("", "\u0345x"), ("\u0345", "x"), ("", "\u0334x"), ("\u0334", "x"), ("", "\u0323\u0301x"), ("\u0301", "\u0323x"), ("\u0323", "\u0308\u0334")]
    said = ["".join(f"a{a}{m}{z} " for a, z in around) for m in marks] + [f"{p}x {p}\u0323 a{p[-1]}\u0345{p} " for p in parts]
    rnd = random.Random(3)
    some = marks + ["a", "e", "O", "\u1100", "\u1161", "\u11a8", "\U00011935", "\U00011930", "\u0915"] * 30
    said += ["".join(rnd.choice(some) for _ in range(12)) for _ in range(5000)]
    for t, x, y in zip(said, own.encode(said), library.encode_batch(said, add_special_tokens=False)):
        assert np.frombuffer(x, "<u4").tolist() == y.ids, ascii(t)


@pytest.mark.parametrize("name", ["a.b", "text_", "`"])
def test_other_columns_stay(spark, name):
    df = spark.createDataFrame([("one", 1), (None, 2), ("one", 1)], "text string, other long").withColumnRenamed("other", name)
    out = bpe.decode(bpe.encode(df, WORD_BPE), WORD_BPE)
    assert out.columns == ["text", name, "ids", "decoded"]
    assert sorted(r[1] for r in out.collect()) == [1, 1, 2]


def test_columns_and_digests(spark):
    rows = [(1, "two words", "k", None), (2, None, None, [1]), (None, "", "e", [2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids array<int>")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(df, WORD_BPE), WORD_BPE).collect()}
    assert got[1].decoded == "two</w> words</w>" and got[2].ids == [] and got[2].decoded == "" and got[None].text == ""
    d = {r.doc_id: r for r in bpe.digests(df, WORD_BPE).collect()}
    assert d[1].n_tokens == 2 and d[1].ids_sha256 == hashlib.sha256(" ".join(map(str, got[1].ids)).encode()).hexdigest()
    assert bpe.digests(df.limit(0), WORD_BPE).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_lengths(n):
    parts = packing.lengths(n, 2048)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
    assert len({*parts} - {2048}) == len([p for p in parts if p < 2048])


def test_pieces(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(1000, None, None), (1, "again " * 5000, "y"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack(spark, df, WORD_BPE, with_ids=True).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got)))
    assert {r.offset for r in got} == {0} and {r.length & (r.length - 1) for r in got} == {0}
    by_length = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert by_length == sorted(by_length, reverse=True)
    library = Tokenizer.from_file(WORD_BPE)
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in got if r.doc_id == i and r.doc_tokens == len(ids)), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    assert packing.pack(spark, df.limit(0), WORD_BPE).count() == 0
