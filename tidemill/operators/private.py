"""Personal data and secrets in texts: spans by one scan, checked by checksums and entropy.

One pattern of alternatives (see PATTERNS; the first that matches at a place counts, and spans don't overlap) is run over
each text. What it finds is then checked: card numbers by their Luhn sum, account numbers (IBAN) by their remainder
of 97, addresses by the size of their numbers, tokens by having letters and digits and at least ENTROPY bits a character by
how often each character stands in them. What fails its check is no span.

Null texts hold none. Null doc_ids are kept. Repeated rows give repeated spans. Very long texts are taken whole. An
empty table gives nothing. Columns other than doc_id and text are ignored by spans() and counts(), and kept by
redact(), whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Alternatives by kind, in order. Without look-around, so that engines of other kinds find the same.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}\b",
    "ip": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "card": r"\b[0-9](?:[ -]?[0-9]){12,18}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
    "token": r"\b[A-Za-z0-9_]{24,}\b",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
NAMED = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()), re.ASCII)
ENTROPY = 3.0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def entropy(text: str) -> float:
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def valid(kind: str, said: str) -> bool:
    if kind == "ip":
        return all(int(x) < 256 for x in said.split("."))
    if kind == "card":
        return luhn(re.sub("[ -]", "", said))
    if kind == "iban":
        code = said.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    if kind == "token":
        return re.search("[0-9]", said) is not None and re.search("[A-Za-z]", said) is not None and entropy(said) >= ENTROPY
    return True


def find(text: str | None) -> list[tuple[str, int, int]]:
    """kind, start and stop (in code points) of each span, in order."""
    return [(m.lastgroup, m.start(), m.end()) for m in NAMED.finditer(text or "") if valid(m.lastgroup, m[0])]


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, stop: a row for each span."""

    def run(batches):
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                if found := find(t.as_py()):
                    kind, start, stop = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found), pa.int64()), pa.array(kind), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc_id", "kind", "start", "stop"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, start long, stop long")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, kind, n, chars: how many spans of a kind a document has, and their characters."""
    return spans(docs).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop") - F.col("start")).alias("chars"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with <KIND> in the place of each span; null texts stay null."""

    def run(batches):
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                parts, at = [], 0
                for kind, start, stop in find(t):
                    parts += [t[at:start], f"<{kind.upper()}>"]
                    at = stop
                out.append("".join(parts) + t[at:] if parts else t)
            yield b.set_column(b.schema.names.index("text"), "text", pa.array(out, b.column("text").type))

    # the row's own columns stay in a struct, so that no name of theirs meets one of ours
    rows = docs.select(F.struct("*").alias("row"), "text")
    rows = rows.mapInArrow(run, rows.schema)
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
