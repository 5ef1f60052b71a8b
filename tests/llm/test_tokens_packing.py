"""Token files and packing against direct encoding and plain packing."""

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import packing, tokens
from siftwell.llm.common import new_path

TEXTS = ["Hello, World!!", "", None, "don't  stop» ... \t(x).", "<|endoftext|> a <|ENDOFTEXT|>.,", "ÀÉ é. 123 ab12", " a b", "x" * 3000, "word " * 9000, "'s 're abc'., 中文。", "K İ ſ", "word " * 9000]


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in TEXTS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def docs(spark, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")


def test_encoder_equals_the_library(direct):
    offsets, ids = tokens.TextEncoder(tokens.tokenizer_path()).encode(pa.array(TEXTS, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == direct


def test_encoder_forgets_without_harm(direct, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED_WORDS", 3)
    e = tokens.TextEncoder(tokens.tokenizer_path())
    for _ in range(2):
        offsets, ids = e.encode(pa.array(TEXTS, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == direct


def test_words_of_letters_are_encoded_together():
    r = np.random.default_rng(5)
    words = ["".join(r.choice(list("abcdefghÀÉßéüñABZ"), int(n))) for n in r.integers(1, 30, 500)]
    texts = [" ".join(words), "n\u0303 e\u0301t " + words[0], "x² ÷ × ŉ " + words[1]]
    e = tokens.TextEncoder(tokens.tokenizer_path())
    whole, single = e.tokenizer, []

    class Counted:
        model = None

        def encode_batch_fast(self, pieces, **options):
            single.extend(pieces)
            return whole.encode_batch_fast(pieces, **options)

    e.tokenizer = Counted()
    offsets, ids = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [whole.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert len(single) < 10


def test_token_files_round_trip(spark, direct):
    out = new_path(spark, "t")
    tokens.write_tokens(docs(spark), out, tokens.tokenizer_path(), files=3)
    got = {r["doc_id"]: r for r in tokens.token_digests(tokens.read_tokens(spark, out)).collect()}
    at = 0
    for i, ids in enumerate(direct):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    some = tokens.read_tokens(spark, out, first=3, last=4)
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {3: direct[3], 4: direct[4]}
    assert "ids" not in tokens.read_tokens(spark, out, ids=False).columns


def test_token_files_of_ties_nulls_and_nothing(spark, direct):
    out = new_path(spark, "t")
    tokens.write_tokens(docs(spark, [None, 5, 5] + [7] * 9), out, tokens.tokenizer_path(), files=2)
    rows = tokens.token_digests(tokens.read_tokens(spark, out)).collect()
    assert len(rows) == 12 and sorted(r["ids_crc32"] for r in rows) == sorted(map(crc, direct))
    spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in rows)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    empty = new_path(spark, "t")
    tokens.write_tokens(docs(spark).filter("false"), empty, tokens.tokenizer_path())
    assert tokens.token_digests(tokens.read_tokens(spark, empty)).count() == 0


def check(rows, capacity=4096):
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(p, p[1:])) and p[-1][0] + p[-1][1] <= capacity
    return len(places)


def test_best_fit_is_best_fit():
    r = np.random.default_rng(0)
    sizes = r.integers(1, 100, 400)
    bins, places = packing.best_fit(sizes, 100)
    rooms = []
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [x for x in rooms if x >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(100 - s)
    assert bins.max() + 1 == len(rooms)
    assert all((places[i] + sizes[i] <= 100) for i in range(400))


def test_packing_of_documents(spark, direct):
    rows = packing.pack_pieces(packing.token_pieces(docs(spark, [1] * 12), tokens.tokenizer_path()), group_items=3).collect()
    want = sorted((k // 4096, k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for ids in direct for k in range(0, len(ids), 4096))
    assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert check(rows) == math.ceil(sum(map(len, direct)) / 4096)


def test_rounds_meet_lopsided_groups(spark):
    r = np.random.default_rng(1)
    sizes = np.concatenate([np.full(300, 3000), r.integers(1, 1000, 900), np.full(50, 4096)])
    df = spark.createDataFrame([(i, 0, 0, int(s), i) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack_pieces(df, group_items=100).collect()
    best = packing.best_fit(sizes, 4096)[0].max() + 1
    assert len(rows) == len(sizes) and check(rows) <= 1.03 * best
    assert packing.pack_pieces(df.filter("false")).count() == 0
