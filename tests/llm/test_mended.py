"""Licence notices with words put in, left out or replaced; precision and recall of the field; small files and equal rows."""

import random
import re
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import common, licenses, secret_scan, tokens, warc
from siftwell.llm.common import new_path

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def cut(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def variants(template):
    """The notice with one word more, less or other, at every place outside its key phrases."""
    words = cut(template.text)
    keyed = set()
    for key in template.keys:
        parts = key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)
        keyed |= set(range(at, at + len(parts)))
    for i in range(len(words) + 1):
        if not (i in keyed and i - 1 in keyed):
            yield words[:i] + ["inserted"] + words[i:]
    rare = [i for i, w in enumerate(words) if w not in licenses.COMMON]
    for i in range(len(words)):
        # two rare words are the least a placement takes
        if i not in keyed and not (i in rare and len(rare) <= 2):
            yield words[:i] + words[i + 1 :]
            yield words[:i] + ["other"] + words[i + 1 :]


def plain_labels(text, band=licenses.BAND):
    """Labels by brute force over all placements: enough of a template's rare words whose shifts lie within a band."""
    words, found = cut(text), set()
    for t in licenses.TEMPLATES:
        own = [(q, w) for q, w in enumerate(cut(t.text)) if w not in licenses.COMMON]
        need = max(2, int(np.ceil(licenses.LEAST_SHARE * len(own))))
        votes = [(i - q, q) for i, x in enumerate(words) for q, w in own if x == w]
        enough = any(len({q for d, q in votes if s <= d <= s + band}) >= need for s in {d for d, _ in votes})
        if enough and all(f" {k} " in f" {' '.join(words)} " for k in t.keys):
            found.add(t.label)
    for phrase, label in licenses.PHRASES.items():
        if f" {phrase} " in f" {' '.join(words)} ":
            found.add(label)
    return ",".join(sorted(found))


def labels(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = licenses.license_scan(df, licenses.inverse_frequencies(df)).select("doc_id", "labels").collect()
    return [x["labels"] for x in sorted(got, key=lambda x: x["doc_id"])]


def test_one_word_changed_keeps_every_label(spark):
    r = random.Random(6)
    cases = []
    for t in licenses.TEMPLATES:
        for words in variants(t):
            filler = [f"w{r.randrange(50)}" for _ in range(12)]
            cases.append((t.label, " ".join([*filler[:6], *words, *filler[6:]])))
    lost = [(want, text) for (want, text), got in zip(cases, labels(spark, [t for _, t in cases]), strict=True) if want not in got.split(",")]
    assert len(cases) > 600 and lost == []


def test_labels_equal_brute_force_over_placements(spark):
    r = random.Random(7)
    pool = [w for t in licenses.TEMPLATES for w in cut(t.text)] + [f"w{k}" for k in range(40)]
    texts = [" ".join(r.choice(pool) for _ in range(r.randrange(60))) for _ in range(120)]
    for _ in range(200):
        words = []
        for _ in range(r.randrange(1, 4)):
            own = cut(r.choice(licenses.TEMPLATES).text)
            for w in own:
                if r.random() > 0.08:
                    words.append(w)
                if r.random() < 0.06:
                    words.append(r.choice(pool))
            words += [f"w{r.randrange(40)}" for _ in range(r.randrange(5))]
        texts.append(" ".join(words))
    assert labels(spark, texts) == [plain_labels(t) for t in texts]


def test_words_are_cut_once_and_as_fast_as_by_their_separators(spark):
    r = random.Random(10)
    odd = "\x00\x1f /09:@AZ[`az{\x7f\x80\x85\xa0\xad\u00e9\u0130\u212a\u2028\ud7ff\ue000\ufffd\uffff\U00010000\U0010ffff\n\r\t"
    texts = ["".join(r.choice(odd) for _ in range(r.randrange(80))) for _ in range(300)] + [*odd, *map(chr, range(0x180)), None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    # letters beyond ASCII may be others of the same class
    same = lambda words: [re.sub("[^\x00-\x7f]", "?", w) for w in words]
    assert [same(x["w"]) for x in df.select(licenses._words(F.col("text")).alias("w")).collect()] == [same(cut(t or "")) for t in texts]
    plan = licenses.document_frequencies(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat(F.lit("pour\u00e9ne, "), F.hex(F.hash(i, "id"))))
    stored = common.stored(spark.range(0, 8000, 1, 8).select(F.array_join(words, " ").alias("text")), "test")

    def seconds(column):
        took = []
        for _ in range(4):
            start = time.perf_counter()
            stored.agg(F.sum(F.size(column))).collect()
            took.append(time.perf_counter() - start)
        return min(took)

    assert seconds(licenses._words(F.col("text"))) < 4 * seconds(F.split(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def prose(r, names, n):
    return " ".join(r.choice(names) for _ in range(n))


def test_field_finds_planted_secrets_and_leaves_prose_alone():
    r = random.Random(8)
    letters = "etaoinsrhldu"
    # an invented language with long words, as compounds have them
    names = ["".join(r.choice(letters) for _ in range(r.randrange(2, 17))) for _ in range(900)]
    text = lambda: f'{prose(r, names, 40)} token = "{r.getrandbits(160):040x}" {prose(r, names, 40)}' if r.random() < 0.6 else prose(r, names, 90)
    field = secret_scan.learn([text() for _ in range(400)])
    false, hits, planted, wrong = secret_scan.judged(field, [text() for _ in range(200)], seed=5)[0]
    assert planted > 150 and hits / planted >= 0.75 and hits / (hits + wrong + false) >= 0.9
    plain = [prose(r, names, 400) + " the key of the house" for _ in range(200)]
    assert sum(len(s) for s in secret_scan.secret_spans(pa.array(plain), field)) == 0


def test_a_thousand_token_files(spark):
    docs = spark.range(1500).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id")).alias("text"))
    out = new_path(spark, "many")
    tokens.write_tokens(docs, out, tokens.tokenizer_path(), files=1000)
    block, tokens.SHARDS_A_BLOCK = tokens.SHARDS_A_BLOCK, 16
    try:
        got = sorted(tokens.token_digests(tokens.read_tokens(spark, out)).collect(), key=lambda x: x["doc_id"])
    finally:
        tokens.SHARDS_A_BLOCK = block
    at = 0
    for x in got:
        assert x["start"] == at
        at += x["n_tokens"]
    assert len(got) == 1500


def test_equal_rows_spread_over_archives(spark):
    pages = spark.range(0, 10_000, 1, 8).select(F.lit(None).cast("long").alias("page_id"), F.lit("http://a.example/").alias("url"), F.lit("same").alias("html"))
    out = new_path(spark, "equal")
    warc.write_archives(pages, out, file_bytes=4000)
    per = [r["count"] for r in spark.read.text(out).filter(F.col("value").startswith("WARC-Type")).groupBy(F.input_file_name()).count().collect()]
    assert sum(per) == 10_000 and max(per) <= 5000
    lines = warc.merged_index(warc.index_runs(spark, out)).collect()
    assert len(lines) == 10_000 and Counter(x["page_id"] for x in lines) == {None: 10_000}


@pytest.mark.parametrize(("heap", "times"), [(500, 1), (300, 0)])
def test_a_grown_heap_of_the_driver_is_collected_after_each_table(heap, times):
    calls = []
    memory = SimpleNamespace(totalMemory=lambda: heap << 20, maxMemory=lambda: 750 << 20)
    jvm = SimpleNamespace(java=SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: memory))), System=SimpleNamespace(gc=lambda: calls.append(1)))
    reader = SimpleNamespace(parquet=lambda path: "table")
    spark = SimpleNamespace(_jvm=jvm, conf={"spark.checkpoint.dir": "/nowhere"}, read=SimpleNamespace(schema=lambda schema: reader))
    df = SimpleNamespace(write=SimpleNamespace(parquet=lambda path: None), schema=None, sparkSession=spark)
    assert common.Scratch(spark).stored(df, "x") == "table" and len(calls) == times
    assert common.stored(df, "x") == "table" and len(calls) == 2 * times


def test_shapes_of_a_block_are_those_of_its_words(monkeypatch):
    r = random.Random(3)
    marks = "aAbBcCdDzZ019=:\"'`()[]{}<>,;.!?#*$%&|/@_+-éÉßſK²٣字Ωxsµİ"
    words = ["".join(r.choice(marks[: r.choice([6, 12, 40, len(marks)])]) for _ in range(r.choice([1, 2, 3, 8, 9, 15, 24, 30]))) for _ in range(4000)]
    words += ["AKIA1", "ghp_x", '"sk_', "xox", "ſecret", "toKen", "'", "...", "a'.", "='", "aabbccdd" * 2, "aaabbbcccdddeeefffggghhh", "abcdefgh", "//", "a/b/c", "a" * 70_000, "=" * 70_000]
    want = np.array([secret_scan.shape(w) for w in words])
    monkeypatch.setattr(secret_scan, "SHAPE_BYTES", 1000)
    assert (secret_scan.shapes(pa.array(words)) == want).all()
    assert secret_scan.shapes(pa.array([], pa.string())).shape == (0, len(secret_scan.SHAPES))


def test_usual_words_are_not_shaped_one_by_one(monkeypatch):
    one, count = secret_scan.shape, []
    monkeypatch.setattr(secret_scan, "shape", lambda word: count.append(word) or one(word))
    w = secret_scan.featured(pa.array([" ".join(f"word{k} Straße{k} ünit-{k}=x" for k in range(300)), None, "字"]))
    assert np.diff(w.offsets).tolist() == [900, 0, 1] and count == ["字"]


@pytest.mark.parametrize(("asked", "least", "most"), [(None, 0, 4.3e6), ("16m", 8e6, 17e6)])
def test_a_scan_takes_whole_texts_in_small_batches(spark, asked, least, most):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("word "), 20_000).alias("text"))
    spark.conf.unset(common.ARROW_SETTING)
    try:
        if asked:
            spark.conf.set(common.ARROW_SETTING, asked)
        field = secret_scan.Field(np.zeros((3, len(secret_scan.SHAPES), 3)), np.zeros((secret_scan.AROUND, 3)), np.zeros((3, 3)))
        found = secret_scan.scan(docs, field, redact=True)
        largest = docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
        assert least < largest < most and found.count() == 200
    finally:
        spark.conf.unset(common.ARROW_SETTING)
