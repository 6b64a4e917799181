import random

import numpy as np
import pytest
import xxhash

from tidemill.llm import jaccard as jaccard_join
from tidemill.llm import simhash


def plain(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints):
    """Brute force: place of the first member of each one's component."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3 and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


TEXTS = [None, "", " \t\n", "one", "One two", "one two three", "a b c d e f g h", "É é A\x0bB c\xa0d", "x " * 5000, "the cat sat on the mat " * 3]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) == plain(t), t


def test_links_against_all_pairs():
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    prints = {0, 1, (1 << 64) - 1}
    for s in seeds:
        for _ in range(rnd.randrange(12)):
            x = s
            for _ in range(rnd.randrange(7)):
                x ^= 1 << rnd.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    x = np.array(prints, np.uint64)
    order = np.argsort(simhash.gray_rank(x))
    want = classes([int(v) for v in x[order]])
    label = list(range(len(x)))
    for turn in range(4):  # the four masks together
        t = np.uint64(16 * turn)
        y = (x << t) | (x >> (np.uint64(64) - t)) if turn else x
        o = np.argsort(simhash.gray_rank(y))
        for i, j in enumerate(simhash.links(y[o], 16, 3)[0]):
            a, b = label[o[i]], label[o[j]]
            label = [min(a, b) if v in (a, b) else v for v in label]
    group = lambda l: {frozenset(i for i, v in enumerate(l) if v == k) for k in l}
    assert group(label) == {frozenset(prints.index(int(x[order][i])) for i in g) for g in group(want)}


def test_dense_group_small_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    rnd = random.Random(1)
    base = rnd.getrandbits(64) | 1
    x = np.array(sorted({base ^ (1 << a) ^ (1 << b) for a in range(48) for b in range(48)}), np.uint64)
    x = x[np.argsort(simhash.gray_rank(x))]
    assert len(set(simhash.links(x, 16, 3)[0].tolist())) == 1


def test_near_duplicates(spark):
    rnd = random.Random(2)
    base = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 5) for _ in range(300)) for _ in range(12)]
    texts = [*TEXTS, *base, *[b + " more" for b in base], *base[:3], "zz " + base[0]]
    texts += ["very long " + " ".join(f"w{i % 5003}" for i in range(150_000)), "a very long " + " ".join(f"w{i % 5003}" for i in range(150_000))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, texts[5], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(df).collect()}
    prints = [plain(t) for t in texts]
    label = classes(prints)
    assert {k: v for k, v in got.items() if k[0] is not None} == {(i, f"{p:016x}"): l for i, (p, l) in enumerate(zip(prints, label))}
    assert got[None, f"{prints[5]:016x}"] == label[5]
    assert simhash.near_duplicates(df).count() == len(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def jaccard(a, b, size=5):
    sets = []
    for t in (a, b):
        w = t.lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def alike(a, b, size=5):
    """Texts without words are copies of each other."""
    return jaccard(a, b, size) >= 0.8


def test_dedup_keeps_what_only_fingerprints_link(spark):
    """Texts that the index links, but whose shingles of five words are less similar than 0.8."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(300)]
    base = [rnd.choice(words) for _ in range(1500)]
    texts = [" ".join(base)]
    while len(texts) < 3:
        copy = list(base)
        for _ in range(80):
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
        copy = " ".join(copy)
        if jaccard(texts[0], copy) < 0.8 and (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(copy)).bit_count() <= 3:
            texts.append(copy)
    assert kept(spark, texts + ["another text"]) == [0, 1, 2, 3]


def test_dedup_keeps_texts_of_one_phrase(spark):
    """Each repeats one phrase and has 50 words of its own: equal fingerprints, Jaccard similarity 0.03 or less."""
    phrase = " ".join(["alpha beta gamma"] * 400)
    texts = [phrase + " " + " ".join(f"w{k}x{i}" for i in range(50)) for k in range(3)]
    texts += [texts[1] + " end", phrase]
    assert (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).bit_count() <= 3 and jaccard(texts[0], texts[1]) < 0.05
    assert kept(spark, texts) == first_of_groups(texts) == [0, 1, 2, 4]


@pytest.mark.parametrize("name", ["_key", "_id", "_n", "_text_key", "row", "text_key", "key", "id", "a.b", "doc"])
def test_dedup_keeps_columns_of_any_name(spark, name):
    df = spark.createDataFrame([(1, "one text", "x"), (2, "one text", "y"), (3, None, "z"), (3, None, "z")], f"doc_id long, text string, `{name}` string")
    out = simhash.dedup(df)
    assert out.columns == ["doc_id", "text", name]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "one text", "x"), (3, None, "z")]


def test_dedup(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(2, 8))) for _ in range(2000)]
    texts = []
    for g in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randrange(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(4)):
            copy = list(base)
            for _ in range(len(base) // 60):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(copy))
    texts += [texts[0], "", None, "one", "One", "two words", "other words"]
    rows = [(i, t, i % 3, "c") for i, t in enumerate(texts)] + [(0, texts[0], 0, "c"), (None, texts[3], 1, None), (None, "only here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tid int, key string")
    out = simhash.dedup(df).collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "tid", "key"}
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if alike(a or "", texts[j] or ""):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    want = sorted({*label}) + [None]
    assert sorted((r.doc_id for r in out), key=lambda x: (x is None, x)) == want
    assert simhash.dedup(df.limit(0)).count() == 0


def kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return sorted(r.doc_id for r in simhash.dedup(df).collect())


def first_of_groups(texts, size=5):
    label = list(range(len(texts)))
    for i, a in enumerate(texts):
        for j in range(i):
            if alike(a, texts[j], size):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    return sorted({*label})


def test_dedup_of_texts_with_one_word_set(spark):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(40)]
    orders = [rnd.sample(words, 40) for _ in range(6)]
    texts = ["alpha beta gamma", "gamma beta alpha", "gamma  beta alpha"]
    for o in orders:  # each order twice, the second time with its first word at the end
        texts += [" ".join(o), " ".join(o[1:] + o[:1])]
    want = first_of_groups(texts)
    assert want == [0, 1, *range(3, 15, 2)] and kept(spark, texts) == want


def test_dedup_of_texts_with_blocks_added_or_cut(spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    texts = []
    for n in [*range(20, 300, 14)]:
        base = [rnd.choice(words) for _ in range(n)]
        texts += [" ".join(base), " ".join(base + [rnd.choice(words) for _ in range(n // 6)]), " ".join(base[n // 7 :])]
        other = [rnd.choice(words) for _ in range(13)]
        texts += [" ".join(other), " ".join(other[:-1] + ["changed"])]
    want = first_of_groups(texts)
    assert len(want) < len(texts) / 2 and kept(spark, texts) == want


def test_what_the_index_links_is_left_out_of_the_join(spark, monkeypatch):
    """Pairs that fingerprints lead to are compared first; the join gets only what they leave."""
    joined, plain = [], jaccard_join._join_units
    monkeypatch.setattr(jaccard_join, "_join_units", lambda placed, unit, similarity: (joined.append(sorted(r.tid for r in placed.select("tid").distinct().collect())), plain(placed, unit, similarity))[1])
    rnd = random.Random(14)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(4000)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    near = [say(1500) for _ in range(4)]
    near += [t + " end" for t in near] + [say(100)]
    assert all((simhash.fingerprint(near[i]) ^ simhash.fingerprint(near[i + 4])).bit_count() <= 3 for i in range(4))
    assert kept(spark, near) == [0, 1, 2, 3, 8]
    assert len(joined) == 2 and len(joined[0]) == 8 and joined[1] == []
    joined.clear()
    far = say(100)
    far = [far, far + " " + say(20)]
    assert (simhash.fingerprint(far[0]) ^ simhash.fingerprint(far[1])).bit_count() > 3 and alike(*far)
    assert kept(spark, near + far) == [0, 1, 2, 3, 8, 9]
    assert len(joined[0]) == 8 and len(joined[1]) == 2


def test_dedup_of_many_texts_with_one_core(spark, monkeypatch):
    """Most of these share their shingles and aren't similar; some pairs far from the first are."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "LISTED", 4)
    rnd = random.Random(10)
    core = [f"w{i}" for i in range(60)]
    texts = []
    for k in range(40):
        own = list(core)
        for i in rnd.sample(range(60), rnd.choice([1, 1, 2, 3])):
            own[i] = f"x{k}{i}"
        texts.append(" ".join(own))
        if k % 5 == 0:
            texts.append(" ".join(own + ["end"]))
    want = first_of_groups(texts)
    assert 5 < len(want) < len(texts) and kept(spark, texts) == want
