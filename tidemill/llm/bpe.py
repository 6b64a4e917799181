"""Byte-pair encoding with word ends, and decoding.

Texts are cut at white space; each distinct chunk is looked up in a bounded cache, and those not met yet are encoded
together: the symbols of all their words stand in one flat array, and in each round every word merges its lowest-rank
pair, found by binary search over the sorted keys of all pairs.

Null texts count as empty and give no ids. Very long texts and words take more rounds, not more memory than their own
symbols. Equal texts give equal ids, repeated rows repeated results. Other columns of the input, whatever their names,
are kept unless they are called like a new one, which takes their place. An empty table gives nothing.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemill.llm.common import columns, numbered, sha

#: White space as the tokenizer's own pattern has it, and what its word pattern splits off.
BLANK = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = re.compile(f"[{BLANK}]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Letters, numbers and pairs of cases (first and last capital, distance to the small one) that the
#: library knows and Python's own tables, of Unicode 15.1, don't: those of Unicode 16, and for cases also of 17.
MORE_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
MORE_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
MORE_CASES = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]
#: Marks whose order in a text the library's normal form, of Unicode 9, leaves as it is, as it doesn't know
#: them; and U+11930, which it doesn't join to what stands before.
UNORDERED = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA),
    (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47),
    (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136),
    (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
APART = re.compile("([" + "".join(f"{chr(a)}-{chr(z)}" for a, z in UNORDERED) + "])")
LOWER = {c: c + to for a, z, to in MORE_CASES for c in range(a, z + 1)}
HAS_LOWER = re.compile("[" + "".join(f"{chr(a)}-{chr(z)}" for a, z, _ in MORE_CASES) + "]")


def characters(kind: str, more: list[tuple[int, int]]) -> str:
    """Ranges of a character class: the code points whose general category begins with kind, and more."""
    known = {c for a, z in more for c in range(a, z + 1)}
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind or c in known]
    first = [c for c, before in zip(found, [-2, *found]) if c != before + 1]
    last = [c for c, after in zip(found, [*found[1:], -2]) if c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(first, last))


LETTERS, NUMBERS = characters("L", MORE_LETTERS), characters("N", MORE_NUMBERS)
WORD = re.compile(f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^{BLANK}{LETTERS}{NUMBERS}]+")
STOP = re.compile(r"(?<=[a-zà-öø-ÿ])([.,])(?=[ \n])")
#: Marks a special token among chunks; white space, so no chunk begins with it.
SPECIAL = " "
NONE = np.int64(1) << 40


def normal(text: str) -> str:
    """The library's normal form C: a mark that it doesn't know stands for itself, and what is on either side does not meet."""
    if not APART.search(text):
        return unicodedata.normalize("NFC", text)
    return "".join(unicodedata.normalize("NFC", part) for part in APART.split(text))


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones stand for themselves, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A tokenizer file of the kind BPE with end-of-word suffix: NFC, lower case, white space dropped."""

    def __init__(self, path: str, cache_entries: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens: list[str] = [""] * size
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.decimals = [str(i) for i in range(size)]
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocab[c + end] for c in byte_symbols()], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = np.int64(size)
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if len(set(self.made.tolist())) != len(pairs):
            raise ValueError("two merges make one token: merging all places of a pair at once would not be exact")
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.limit = cache_entries
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word; words aren't empty."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        sym = self.inner[flat]
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            key = np.full(len(sym), -1, np.int64)
            key[:-1] = np.where(word[1:] == word[:-1], sym[:-1] * self.size + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], NONE)
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            live = best < NONE
            done_sym.append(sym[~live])
            done_word.append(word[~live])
            hit = np.flatnonzero((rank == best) & live)
            if not len(hit):
                break
            run = np.r_[True, np.diff(hit) != 1]  # of a run of touching places every second one merges, from the left
            odd = (hit - hit[np.flatnonzero(run)[np.cumsum(run) - 1]]) % 2 == 1
            hit = hit[~odd]
            sym[hit] = self.made[rank[hit]]
            live[hit + 1] = False
            sym, word = sym[live], word[live]
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        stop = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [sym[a:b] for a, b in zip([0, *stop], stop)]

    def _chunks(self, text: str) -> list[str]:
        """The text in normal form, cut at white space and between a word and a stop that ends it."""
        if not text.isascii():
            text = normal(text).replace("Σ", "σ")
            text = text.translate(LOWER) if HAS_LOWER.search(text) else text
        text = STOP.sub(r" \1", text.lower())
        return SPACE.split(text) if NOT_SPACE.search(text) else text.split()

    def _cut(self, text: str) -> list[str]:
        if self.cut is None or "<|" not in text:
            return self._chunks(text)
        out = []
        for part in self.cut.split(text):
            out += [SPECIAL + part] if part in self.special else self._chunks(part)
        return out

    def _learn(self, chunks: set[str]) -> None:
        """Puts into the cache what isn't there; the generation before the present one is still looked up."""
        known, old = self.known, self.old
        chunks = chunks.difference(known)
        again = [c for c in chunks if c in old]
        known.update((c, old[c]) for c in again)
        chunks.difference_update(again)
        split = {c: WORD.findall(c) for c in chunks if not c.isalpha() and c[:1] != SPECIAL}
        known.update((c, np.array([self.special[c[1:]]], "<u4").tobytes()) for c in chunks if c[:1] == SPECIAL and c not in split)
        new = [c for c in chunks if c.isalpha()]
        new += {w for ws in split.values() for w in ws}.difference(known, new)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            known.update(zip(part, self.merge([w.encode("utf-8", "surrogatepass") for w in part])))
        known.update((c, b"".join([known[w] for w in ws])) for c, ws in split.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):  # so many texts at a time that a generation of the cache holds their chunks
            new: set[str] = set()
            cut = []
            held = 0
            while at < len(texts) and (not cut or held < self.limit):
                cut.append(self._cut(texts[at]))
                new.update(cut[-1])
                held += len(cut[-1])
                at += 1
            if len(self.known) > self.limit:
                self.old, self.known = self.known, {}
            self._learn(new)
            get = self.known.__getitem__
            out += [b"".join(map(get, c)) for c in cut]
        return out

    def decode(self, ids: list[int]) -> str:
        """What the tokenizers library gives for a file without a decoder: the tokens joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(4)
def load(path: str, cache_entries: int = 400_000) -> WordBpe:
    """One for each Python worker, which keeps it and its cache while it lives: some 400 bytes for each entry."""
    return WordBpe(path, cache_entries)


def _plus(df: DataFrame, column: str, new: StructField, work) -> DataFrame:
    """df and one more column: work, of a tokenizer's task, gives it for a batch of the values of column."""
    df = df.select(*columns(df, *({new.name} - {column})))
    at = df.columns.index(column)
    inner = numbered(df)
    names = [*inner.columns, "new"]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, work(b.column(at).to_pylist())], names=names)

    return inner.mapInArrow(run, StructType([*inner.schema.fields, StructField("new", new.dataType)])).toDF(*df.columns, new.name)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ids array<int>; null texts give an empty array. The file at path is on every machine."""

    def work(texts):
        ids = load(path).encode([x or "" for x in texts])
        stop = np.cumsum([0] + [len(x) // 4 for x in ids], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(stop), pa.array(np.frombuffer(b"".join(ids), "<i4")))

    return _plus(df, text, StructField("ids", ArrayType(IntegerType())), work)


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded string; null ids give an empty string."""
    return _plus(df, ids, StructField("decoded", StringType()), lambda found: pa.array([load(path).decode(x or []) for x in found], pa.string()))


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoding every text and decoding its ids."""
    def run(batches):
        bpe = load(path)
        for b in batches:
            ids, whole = b.column("doc_id"), b.column("text")
            for i in range(0, len(b), 500):
                rows = []
                for x in bpe.encode([t or "" for t in whole.slice(i, 500).to_pylist()]):
                    numbers = np.frombuffer(x, "<u4").tolist()
                    rows.append((len(numbers), sha(" ".join(map(bpe.decimals.__getitem__, numbers))), sha(bpe.decode(numbers))))
                n, a, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([ids.slice(i, 500), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
