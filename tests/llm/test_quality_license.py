"""Quality rules and licence scan against plain versions."""

import re

from siftwell.llm import licenses, quality

TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h " * 5, "x " * 30, "A line here\nA line here\n\n\nother\n", "## %% $$ && word " * 9, "w" * 5000, "\x0bé\x0c ü y\r\n" * 4,
         "LOUD WORDS EVERYWHERE " * 12, " ".join(f"w{i}" for i in range(3000)), " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(30))]


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, where = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            where.update(i + k for i in at for k in range(8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(w), len(where)
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t))
    base = n < 20 or 100 * rep > 30 * n
    bad = base or symbols * 10 > n or len(re.findall("[A-Z]", t)) * 10 > chars * 3 or chars < 2 * n or chars > 20 * n
    return n, chars, symbols, len(lines) - len(set(lines)), rep, base, not bad


def test_counts_and_verdict(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS + TEXTS[:4])], "doc_id int, text string, n_words int")
    got = {}
    for r in quality.quality_rules(df).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")) == plain(r["text"]), r["doc_id"]
        got[r["doc_id"]] = r
    assert len(got) == len(TEXTS) + 4
    assert quality.quality_rules(df.filter("false")).count() == 0


def test_order_does_not_change_the_verdict(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    counted = quality.counts(df)
    rules = quality.standard_rules()
    one = counted.select(quality.passes(rules).alias("a"), quality.passes(rules[::-1]).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in one)
    assert {r.name for r in quality.by_rejection_per_cost(df, rules)} == {r.name for r in rules}


LICENSES = [
    ("Licensed under CC-BY 4.0. cc by cc\nBY", "cc-by"), ("all rights reserved ALL  RIGHTS, reserved", "reserved"), ("GNU General Public License, version 3: This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Released under the MIT License.", "mit"), ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("The mit of license under released", ""), ("generalpublic license accby", ""), ("écc by", ""), (None, ""), ("", ""),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"), ("K İ GENERAL PUBLIC LICENSE", "gpl"), ("filler " * 3000 + "Released under the MIT License. " * 50, "mit"),
]


def test_license_labels_and_places(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(LICENSES)], "doc_id int, text string, labels string")
    idf = licenses.inverse_frequencies(df)
    rows = licenses.license_scan(df, idf).collect()
    assert len(rows) == len(LICENSES)
    for r in rows:
        text, labels = LICENSES[r["doc_id"]]
        w = licenses.words_of(text or "")
        places = [i for p in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None)), text
        assert r["labels"] == labels, text
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(labels)
    assert licenses.license_scan(df.filter("false"), idf).count() == 0


def test_every_notice_of_a_text_is_named(spark):
    text = ". Filler stands here. ".join(t.text for t in licenses.TEMPLATES)
    df = spark.createDataFrame([(text,), ("mit license version 0 gnu licensed",)], "text string")
    for more in ([], ["mit"] * 20):
        idf = licenses.inverse_frequencies(df.union(spark.createDataFrame([(m,) for m in more], "text string")))
        labels = licenses.license_scan(df.limit(1), idf).first()["labels"].split(",")
        assert {t.label for t in licenses.TEMPLATES} <= set(labels)


def test_idf_counts_all_documents(spark):
    df = spark.createDataFrame([("mit",), ("mit MIT",), ("gnu",), ("x",)], "text string")
    idf = licenses.inverse_frequencies(df)
    assert idf["mit"] < idf["gnu"] < idf["apache"]
