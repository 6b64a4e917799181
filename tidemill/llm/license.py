"""License scans: phrases and identifier tags by Aho-Corasick, license expressions by a shunting-yard parser.

A text is lower-cased (A-Z only) and cut into words, runs of characters other than ASCII ones that are neither letter
nor digit. One automaton holds all phrases, written with one space between, before and after their words, so a phrase
is found wherever its words stand consecutively. Identifier tags are found by a second automaton in the lower-cased
text; what follows a tag on its line is read as an expression with or, and, with (in this order of binding, loosest
first), parentheses and a trailing + on identifiers.

Null texts count as empty: no words, no labels, score 0. Overlapping places all count. A line that is no valid
expression gives the identifiers it begins with, up to the fault. Equal texts give equal results, rows are never merged,
null doc_ids are kept. Very long texts are scanned whole, with memory in proportion to their size. An empty table gives
nothing. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases of the method, and identifier tags.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "public domain": "public-domain",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
#: How much a license restricts reuse, from 0 (nothing) to 1, by the first letters of its identifier; longest first.
RESTRICTS = {
    "all-rights-reserved": 1.0, "cc-by-nc": 0.9, "cc-by-nd": 0.9, "agpl": 0.9, "gpl": 0.8, "lgpl": 0.6, "cc-by-sa": 0.6, "mpl": 0.5,
    "apache": 0.2, "bsd": 0.2, "cc-by": 0.2, "mit": 0.1, "isc": 0.1, "cc0": 0.0, "unlicense": 0.0, "public-domain": 0.0,
}
UNKNOWN = 0.7
#: An exception (with) loosens its license by this share.
EXCEPTION = 0.5

BINDS = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(rb"[()]|[a-z0-9][a-z0-9.+-]*")
#: Bytes of UTF-8: A-Z in lower case, ASCII bytes that are no letter or digit as spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def restriction(name: str) -> float:
    found = [k for k in RESTRICTS if name == k or name.startswith(k + "-")]
    return RESTRICTS[max(found, key=len)] if found else UNKNOWN


def postfix(tokens: list[str]) -> list[str]:
    """Tokens of an expression in postfix order; those after a fault are left out."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether one is expected next

    def close(least: int) -> None:
        while stack and stack[-1] != "(" and BINDS[stack[-1]] >= least:
            out.append(stack.pop())

    for t in tokens:
        if operand and t == "(":
            stack.append(t)
        elif operand and t not in BINDS and t != ")":
            out.append(t)
            operand = False
        elif not operand and t in BINDS:
            close(BINDS[t])
            stack.append(t)
            operand = True
        elif not operand and t == ")" and "(" in stack:
            close(0)
            stack.pop()
        else:
            break
    if operand:  # an operator or parenthesis without what should follow
        while stack and (stack[-1] == "(" or len(out) < 1 + sum(x in BINDS for x in [*out, *stack])):
            stack.pop()
    out += [t for t in reversed(stack) if t != "("]
    return out


def evaluate(tokens: list[str]) -> tuple[set[str], float] | None:
    """The license identifiers of an expression, and how much it restricts: or takes the freer side, and the stricter
    one, with loosens. None if there is no operand."""
    stack: list[tuple[set[str], float]] = []
    for t in postfix(tokens):
        if t in BINDS:
            if len(stack) < 2:
                break
            (b, y), (a, x) = stack.pop(), stack.pop()
            stack.append((a, x * EXCEPTION) if t == "with" else (a | b, min(x, y) if t == "or" else max(x, y)))
        else:
            stack.append(({t.rstrip("+")}, restriction(t.rstrip("+"))))
    return stack[-1] if stack else None


@lru_cache(1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in [*BASE.items(), *NOTICES.items()]:
        phrases.add_word(f" {phrase} ", (len(phrase), label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, len(tag))
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, n_tags, expressions of one text."""
    phrases, tags = automata()
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(FOLD).split()
    flat = b" " + b" ".join(words) + b" "
    base, labels, starts, restricts, expressions = set(), set(), [], [], []
    for end, (size, label, is_base) in phrases.iter(flat.decode("latin-1")):
        labels.add(label)
        if is_base:
            base.add(label)
            starts.append(end - size)  # where the phrase's first word begins in flat
    lower = raw.translate(LOWER)
    if b"icense" in lower:
        for end, _ in tags.iter(lower.decode("latin-1")):
            line = lower[end + 1 :].split(b"\n", 1)[0]
            if found := evaluate([t.decode().rstrip(".-") for t in TOKEN.findall(line)]):
                labels |= found[0]
                restricts.append(found[1])
                expressions.append(line.decode("utf-8", "replace").strip())
    restricts += [restriction(x) for x in labels] if not restricts else []
    places = (flat.count(b" ", 0, min(starts)) - 1, flat.count(b" ", 0, max(starts)) - 1) if starts else (None, None)
    return (len(words), len(starts), *places, ",".join(sorted(base)), ",".join(sorted(labels)), max(restricts, default=0.0), len(expressions), expressions)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, expressions array<string>"


def scan(df: DataFrame) -> DataFrame:
    """One row for each document: its words, places of base phrases, labels and how much its licenses restrict reuse
    (score: the strictest expression, or, without one, the strictest label)."""
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.int64(), pa.list_(pa.string())]
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = [(i, *scan_text(t.as_py() or "")) for i, t in zip(ids, b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [[]] * len(names), types)], names=names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
