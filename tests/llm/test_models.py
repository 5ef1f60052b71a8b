"""Classifier, secret field, neighbours and near duplicates against plain versions and held-out cases."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import classifier, near_duplicates, neighbours, secret_scan

WORDS = [f"w{i}" for i in range(500)]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


# ---- classifier


def test_network_learns_and_scores_whole_texts():
    r = random.Random(0)
    data = [(prose(r, r.randrange(5, 200)), 1) for _ in range(300)] + [(prose(r, r.randrange(5, 200)).replace(" ", "### "), 0) for _ in range(100)]
    r.shuffle(data)
    net = classifier.train([t.encode() for t, _ in data[:300]], np.array([y for _, y in data[:300]], np.float32), epochs=30)
    texts = [t for t, _ in data[300:]] + ["", "é"]
    raw = [t.encode() for t in texts]
    p = classifier.probabilities(net, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert np.mean((p[:-2] >= 0.3) == np.array([y for _, y in data[300:]])) > 0.9 and ((p >= 0) & (p <= 1)).all()
    # a text's score is its own, whatever it stands beside
    alone = [classifier.probabilities(net, np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0] for x in raw]
    assert np.allclose(alone, p, atol=1e-5)


def test_every_byte_counts():
    net = classifier.new_network()
    text = np.full(3000, 65, np.uint8)
    base = classifier._pool(net, *classifier.padded(text, np.array([0, 3000])))[0]
    for at in (0, 255, 256, 1500, 2999):
        changed = text.copy()
        changed[at] = 200
        d, f = classifier.padded(changed, np.array([0, 3000]))
        assert d[at] == 200 and len(d) >= 3000 + classifier.WINDOW and int(f[-1]) * classifier.BLOCK >= 3000 + classifier.WINDOW
    assert base.shape[0] == 12


def test_gradients_are_those_of_differences():
    net = classifier.new_network()
    for p in net.parameters():
        p[...] = p.astype(np.float32)
    texts, y = [b"abc def ghi" * 90, b"zz yy", b""], np.array([1, 0, 1], np.float32)

    def loss():
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        p = classifier.probabilities(net, np.frombuffer(b"".join(texts), np.uint8), off)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = classifier._gradients(net, texts, y)
    for p, d in ((net.conv, g[1]), (net.hidden, g[3]), (net.out, g[5])):
        i = np.unravel_index(np.abs(d).argmax(), d.shape)
        keep, h = p[i], 1e-2
        p[i] = keep + h
        up = loss()
        p[i] = keep - h
        assert (up - loss()) / (2 * h) == pytest.approx(d[i], rel=0.1)
        p[i] = keep


def test_score_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (1, "", 9), (2, "x", 9), (None, "x", 9)], "doc_id long, text string, score int")
    net = classifier.train([], np.zeros(0, np.float32))
    got = classifier.score(df, net).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    texts, labels = classifier.labelled_sample(df, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int"))
    assert len(texts) == len(labels) <= 1


# ---- secrets


def test_base_spans_by_hand():
    t = 'é token = "abcd1234" TOKEN:short password=abc AKIA' + "A" * 12 + " AKIAB " + "0" * 32 + " x" + "f" * 31
    assert [(s[1], t[s[0] : s[2]]) for s in secret_scan.base_spans(t)] == [(0, 'token = "abcd1234'), (1, "AKIA" + "A" * 12), (2, "0" * 32)]


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    for n in (1, 2, 4):
        for _ in range(20):
            s, m = r.normal(size=(n, 3)), r.normal(size=(3, 3))
            value = lambda tags: m[2, tags[0]] + m[tags[-1], 2] + sum(s[i, t] for i, t in enumerate(tags)) + sum(m[a, b] for a, b in itertools.pairwise(tags))  # noqa: E731, B023
            assert value(secret_scan.viterbi(s, m).tolist()) == pytest.approx(max(map(value, itertools.product(range(3), repeat=n))))


@pytest.fixture(scope="module")
def field():
    r = random.Random(1)
    return secret_scan.learn([f'{prose(r, 20)} token = "{r.getrandbits(160):040x}" {prose(r, 20)} {r.randrange(10**6)}' for _ in range(80)] + [prose(r, 40) + " call 0123 456 a@b.c" for _ in range(80)])


def test_field_adds_secrets_of_other_shapes(field):
    texts = ["the bearer Zx81Kq92LmNo45PqRs73 is here", "plain words w1 w2 and 12 more", None, ""]
    spans = secret_scan.secret_spans(pa.array(texts, pa.string()), field)
    assert [texts[0][a:b] for a, _, b in spans[0]] == ["Zx81Kq92LmNo45PqRs73"] and spans[1:] == [[], [], []]


@pytest.mark.parametrize(
    ("text", "secret"),
    [
        ("w1 w2 w3 w4 QzXkWvJpLmNtRbYdHsGfTc w5 w6 w7", "QzXkWvJpLmNtRbYdHsGfTc"),
        ("the password for the vault is correcthorsebattery w5 w6", "correcthorsebattery"),
        ('w1 passphrase: "correct horse battery staple" w5 w6 w7', "correct horse battery staple"),
    ],
)
def test_field_reads_every_word(text, secret):
    r = random.Random(2)
    names = ["".join(r.choice("aeiou") if k % 2 else r.choice("bdlmnrst") for k in range(r.randrange(3, 10))) for _ in range(300)]
    some = lambda n: " ".join(r.choice(names) for _ in range(n))
    field = secret_scan.learn([f'{some(20)} token = "{r.getrandbits(160):040x}" {some(20)}' for _ in range(120)] + [some(60) for _ in range(80)])
    text = " ".join(r.choice(names) if re.fullmatch(r"w\d", w) else w for w in text.split())
    assert [text[a:b] for a, _, b in secret_scan.secret_spans(pa.array([text]), field)[0]] == [secret]


def test_viterbi_decodes_texts_each_by_itself():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 40, size=60)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    s, m = r.normal(size=(starts[-1], 3)), r.normal(size=(3, 3))
    got = secret_scan.viterbi(s, m, starts[:-1])
    for a, b in itertools.pairwise(starts.tolist()):
        best, back = m[2] + s[a], []
        for row in s[a + 1 : b]:
            through = best[:, None] + m
            back.append(through.argmax(0))
            best = through.max(0) + row
        tags = [int((best + m[:, 2]).argmax())]
        for k in reversed(back):
            tags.append(int(k[tags[-1]]))
        assert got[a:b].tolist() == tags[::-1]


def test_scan_and_redaction(spark, field):
    text = "é " + "w1 " * 3000 + 'password: "hunter2hunter2" end'
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (2, None, "x"), (3, "", "x")], "doc_id int, text string, spans string")
    got = {r["doc_id"]: r for r in secret_scan.scan(df, field).collect()}
    s, e = map(int, got[1]["spans"].split(",")[0].split(":")[1:])
    assert text[s:e] == 'password: "hunter2hunter2' and got[1]["n_assign"] == 1 and got[2]["spans"] == "" == got[3]["spans"]
    red = sorted(((r["doc_id"], r["text"]) for r in secret_scan.scan(df, field, redact=True).collect()), key=str)
    assert red[0][1].endswith('[secret]" end') and red[1] == (2, None) and len(red) == 4
    assert secret_scan.scan(df.filter("false"), field).count() == 0
    assert secret_scan.learn([]).words[0][0, secret_scan.O] == 1


# ---- neighbours


def brute(x, ids, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = [(-float((x[i] * x[j]).sum()), int(ids[j])) for j in range(len(x)) if j != i]
        out[int(ids[i])] = sorted(s)[:k]
    return out


def test_recall_and_exact_scores(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    x[500:900] = x[500]  # a very common vector
    ids = np.arange(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = {}
    for row in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append((-row["score"], row["vec_id"]))
    want = brute(x.astype(float), ids, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 and v == sorted(v) for v in got.values())
    hits = sum(len({b for _, b in got[q]} & {b for _, b in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q in want:
        true = dict((b, a) for a, b in want[q])
        assert all(true[b] == pytest.approx(a, abs=1e-12) for a, b in got[q] if b in true)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (40, []), (None, [1.0, 1.0]), (7, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [1.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 7, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert neighbours.nearest(df.filter("false")).count() == 0


# ---- near duplicates


def shingles(t):
    w = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))) if w else frozenset()


def plain_components(rows):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    sets = [(i, shingles(t)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def test_components_equal_brute_force(spark):
    r = random.Random(4)
    base = [prose(r, 80) for _ in range(6)]
    passage = prose(r, 60)
    rows = []
    for b in base:
        for edits in [0, 0, 1, 2, 2, 3, 4, 6, 9] * 4:
            w = b.split()
            for _ in range(edits):
                w[r.randrange(len(w))] = f"e{r.random()}"
            rows.append(" ".join(w))
    rows += [passage + " " + prose(r, 40) for _ in range(60)] + ["", None, "a", "A", "b c", "a b c d", "A  B\tc\nd", "x " * 3000, "x " * 2000]
    rows = [(3 * i + 1, t, 1) for i, t in enumerate(rows)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = near_duplicates.near_duplicates(df).collect()
    want = plain_components([(i, t) for i, t, _ in rows])
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for g in got:
        assert g["component_id"] == want[g["doc_id"]] and g["kept"] == (g["doc_id"] == g["component_id"]) and g["n_shingles"] == len(shingles(texts[g["doc_id"]]))


def test_repeated_ids_nulls_and_nothing(spark):
    schema = "doc_id long, text string"
    a, b = "p q r s t u v", "k l m n o p i"
    got = near_duplicates.near_duplicates(spark.createDataFrame([(5, a), (5, b), (9, b), (2, a), (2, a), (None, a), (None, "z z z z")], schema)).collect()
    assert sorted((str(g["doc_id"]), str(g["component_id"]), g["kept"]) for g in got) == [("2", "2", True), ("2", "2", True), ("5", "2", False), ("5", "2", False), ("9", "2", False), ("None", "2", False), ("None", "None", True)]
    assert near_duplicates.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_signature_keys_keep_the_pigeonhole_promise():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = r.integers(0, 1 << 16, (1, 32), dtype=np.uint16)
        b = a.copy()
        at = r.choice(32, r.integers(0, 16), replace=False)
        b[0, at] ^= 1
        assert (near_duplicates.chunk_keys(a) == near_duplicates.chunk_keys(b)).any()


def test_small_tables_take_no_task_for_each_partition_of_each_shuffle(spark):
    r = random.Random(8)
    base = prose(r, 60).split()
    edited = [" ".join(base[:k] + [f"e{k}"] + base[k + 1 :]) for k in range(0, 60, 5)]
    rows = [(i, t) for i, t in enumerate(edited + [" ".join(base)] * 5 + [prose(r, 50) for _ in range(20)])]
    held = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "near duplicates of 37 rows")
        got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in was.items():
            spark.conf.set(k, v)
    assert {g["doc_id"]: g["component_id"] for g in got} == plain_components(rows)
    seen = spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("few-tasks") for s in seen.getJobInfo(j).stageIds}
    done = [i.numCompletedTasks for s in stages if (i := seen.getStageInfo(s))]
    assert sum(done) < 2800  # 3733 with as many tasks and files as shuffles have partitions
