import random

import pytest

from tidemill.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, most, shortest):
    places = []
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\r\x0b\x0c"):
                places.append(((doc is None, doc or 0, n), line))
    close = lambda a, b: a == b or (min(len(a), len(b)) >= shortest and abs(len(a) - len(b)) <= most and distance(a, b) <= most)
    out = {}
    for p, line in places:
        before = [l for q, l in places if q < p and close(l, line)]
        if before:
            out.setdefault(p[:2], []).append((p[2], line not in before))
    return out


def edited(rnd, line, n):
    s = list(line)
    for _ in range(n):
        i = rnd.randrange(len(s) + 1)
        kind = rnd.randrange(3)
        if kind == 0:
            s.insert(i, rnd.choice("abé世"))
        elif s and kind == 1:
            s.pop(min(i, len(s) - 1))
        elif s:
            s[min(i, len(s) - 1)] = rnd.choice("abé世")
    return "".join(s)


@pytest.mark.parametrize(("most", "hot", "sent"), [(1, 256, 100), (2, 256, 0), (3, 256, 100), (1, 1, 100), (2, 1, 0), (3, 2, 100)])
def test_against_all_pairs(spark, most, hot, sent, monkeypatch):
    monkeypatch.setattr(lines, "HOT", hot)
    monkeypatch.setattr(lines, "SENT", sent)
    rnd = random.Random(most)
    base = ["".join(rnd.choice("ab é") for _ in range(rnd.randrange(1, 60))) for _ in range(25)]
    rows = []
    for d in range(40):
        rows.append((d, "\n".join(edited(rnd, rnd.choice(base), rnd.randrange(0, 5)) for _ in range(rnd.randrange(6)))))
    rows += [(40, None), (41, ""), (42, "\n \n\t\r\n"), (None, base[3]), (None, None), rows[5], (3, "another row of three\n" + base[0]), (44, "x" * 500 + "\ny"), (43, "x" * 499 + "z\r\ny")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, removed string")
    got = lines.report(df, most, 12).collect()
    want = brute(list(dict.fromkeys(rows)), most, 12)
    assert len(got) == len(rows)
    seen = {}
    for r in got:
        if r.removed:
            seen.setdefault((r.doc_id is None, r.doc_id or 0), set()).update((int(x)) for x in r.removed.split(","))
    assert seen == {k: {n for n, _ in v} for k, v in want.items()}
    one = {r.doc_id: r for r in got if r.doc_id not in (None, 3, rows[5][0])}
    assert all(one[k[1]].n_near == sum(x for _, x in v) for k, v in want.items() if k[1] in one and not k[0])
    each = lambda text: {x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")} - {""}
    every = set().union(*(each(t) for _, t in rows))
    texts = dict(rows)
    for d, r in one.items():
        assert r.n_links == sum(a != b and min(len(a), len(b)) >= 12 and abs(len(a) - len(b)) <= most and distance(a, b) <= most for a in lines_of(texts[d]) for b in every), d


def lines_of(text):
    return [x for x in (y.strip(" \t\r\x0b\x0c") for y in (text or "").split("\n")) if x]


def test_many_lines_that_share_a_segment(spark, monkeypatch):
    """A segment of 4,000 different lines makes about as many pairs as there are near ones, not their square."""
    rnd = random.Random(7)
    say = lambda n: "".join(rnd.choice("etaniorshlmc") for _ in range(n))
    middle = say(30)
    rows = [(i, say(30) + middle + say(30)) for i in range(4000)]
    rows += [(5000 + i, edited(rnd, rows[i][1], 2)) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written = {}
    write = lines.Scratch.write
    monkeypatch.setattr(lines.Scratch, "write", lambda self, name, df: written.setdefault(name, write(self, name, df).cache()))
    got = {r.doc_id: r.removed for r in lines.report(df).collect()}
    assert {d for d, r in got.items() if r} == {5000 + i for i in range(50)}
    assert written["hot"].count() >= 1
    assert written["met"].count() < 500


def test_many_variants_of_one_line(spark, monkeypatch):
    """3,000 lines, each a base with two letters changed: those with a change in common are near, and all are like the base."""
    monkeypatch.setattr(lines, "BLOCK", 256)
    rnd = random.Random(9)
    base = "".join(rnd.choice("etaniorshlmc ") for _ in range(120)).replace(" ", "x")
    at = set()
    while len(at) < 3000:
        i, j = sorted(rnd.sample(range(120), 2))
        at.add((i, rnd.choice("ABCD"), j, rnd.choice("ABCD")))
    at = sorted(at)
    text = lambda i, a, j, b: base[:i] + a + base[i + 1 : j] + b + base[j + 1 :]
    rows = [(k + 1, text(*x)) for k, x in enumerate(at)] + [(0, base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r for r in lines.report(df).collect()}
    assert {d for d, r in got.items() if r.removed} == set(range(1, 3001)) and got[0].n_links == 3000
    one = {}
    for k, (i, a, j, b) in enumerate(at):
        for x in ((i, a), (j, b)):
            one.setdefault(x, set()).add(k + 1)
    for k, (i, a, j, b) in enumerate(at[:200]):
        # one change in common, and the others apart: two edits where they differ in place; one where they differ in letter only
        near = {n for x in ((i, a), (j, b)) for n in one[x]} | {n + 1 for n, y in enumerate(at) if (y[0], y[2]) == (i, j)}
        near = {n for n in near if distance_of_two(at[n - 1], (i, a, j, b)) <= 2} - {k + 1}
        assert got[k + 1].n_links == len(near) + 1, k


def distance_of_two(x, y):
    """Edits between two variants by substitution; moved letters don't occur in lines of this kind."""
    a, b = {x[0]: x[1], x[2]: x[3]}, {y[0]: y[1], y[2]: y[3]}
    return sum(a.get(i) != b.get(i) for i in a.keys() | b.keys())


@pytest.mark.parametrize("name", ["_key", "_id", "_removed", "_text", "row", "row_key", "row_id", "kept", "removed", "text_key", "a.b", "lines"])
def test_dedup_keeps_columns_of_any_name(spark, name):
    rows = [(1, "one\ntwo", "x"), (2, "two\nthree", None), (3, None, "z")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` string")
    out = lines.dedup(df)
    assert out.columns == ["doc_id", "text", name]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "one\ntwo", "x"), (2, "three", None), (3, None, "z")]


def test_dedup_keeps_columns(spark):
    rows = [(1, "a line that is long enough\nother", "x"), (2, "a line that is long enouhg\nthird\n", None), (3, "third", "y"), (4, "", "z"), (5, None, "n"), (None, "other\n\nnew", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = {r.doc_id: (r.text, r.key) for r in lines.dedup(df).collect()}
    assert got == {1: (rows[0][1], "x"), 2: ("third\n", None), 4: ("", "z"), 5: (None, "n"), None: ("\nnew", "q")}
    assert lines.dedup(df.limit(0)).count() == 0
