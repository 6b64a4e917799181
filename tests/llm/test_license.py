import re

import pytest

from tidemill.llm import license as lic

TEXTS = [
    None, "", "MIT License", "mit-license, MIT  LICENSE; mit license", "the gnu\ngeneral, public license v3 and the Apache License 2.0",
    "CC BY-SA 4.0 cc-by", "éCC BY", "xmit license", "mit license mit license apache license", "cc by cc by cc by", "word " * 9000 + "cc by", "MIT license, " + "long text " * 300_000 + "CC-BY", "GNU GENERAL PUBLİC LICENSE",
]


def brute(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    starts, labels = [], set()
    for phrase, label in lic.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_places_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "cc by", None)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in lic.scan(df).collect()}
    assert got[None].n_base == 1
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert 0 <= r.score <= 1 and (not r.base_labels or set(r.base_labels.split(",")) <= set(r.labels.split(",")))
    assert lic.scan(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("mit", {"mit"}, 0.1), ("mit or gpl-3.0", {"mit", "gpl-3.0"}, 0.1), ("mit and gpl-3.0+", {"mit", "gpl-3.0"}, 0.8),
        ("gpl-2.0 with classpath-exception-2.0", {"gpl-2.0"}, 0.4), ("mit or apache-2.0 and gpl-2.0", {"mit", "apache-2.0", "gpl-2.0"}, 0.1),
        ("(mit or apache-2.0) and gpl-2.0", {"mit", "apache-2.0", "gpl-2.0"}, 0.8), ("((mit))", {"mit"}, 0.1), ("mit and", {"mit"}, 0.1),
        ("mit or (apache-2.0 and", {"mit", "apache-2.0"}, 0.1), ("mit apache", {"mit"}, 0.1), ("and mit", None, None), ("()", None, None), (")", None, None), ("", None, None), ("odd-1", {"odd-1"}, lic.UNKNOWN),
    ],
)
def test_expressions(text, labels, score):
    got = lic.evaluate([t.decode() for t in lic.TOKEN.findall(text.encode())])
    assert got is None if labels is None else (got[0] == labels and got[1] == pytest.approx(score))


def test_tags():
    row = lic.scan_text("// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause\nint x;")
    assert row[5] == "apache-2.0,bsd-3-clause,mit" and row[6] == pytest.approx(0.2) and row[7] == 1


@pytest.mark.parametrize("tag", ["SPDX-LIcense-Identifier:", "SPDX-LicENSe-IDENTIFIER:", "SPDX-LICENSe-Identifier:"])
def test_tags_in_any_case(tag):
    row = lic.scan_text(f"// {tag} MIT OR Apache-2.0")
    assert row[5] == "apache-2.0,mit" and row[7] == 1
