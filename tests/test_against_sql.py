"""Queries against their SQL on rows that the given tables hold few of."""

import duckdb

import __spark_entry__ as entry


def _differences(spark, tmp_path, query, **tables):
    """Rows of the query and of its SQL that the other lacks, as texts, so that zeros keep their signs."""
    con = duckdb.connect()
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[query])
    names = [c[0] for c in want.description]
    text = lambda rows: sorted(tuple(map(repr, r)) for r in rows)
    want, got = text(want.fetchall()), text(entry.queries()[query](spark, str(tmp_path)).select(*names).collect())
    return [r for r in want if r not in got], [r for r in got if r not in want], len(want) - len(got)


def test_cells_of_pages(spark, tmp_path):
    titles = ["a.58@mail8.example.com here", "@you see https://x.example/a www.q.example", "`x` \\ | {a} (b) #1", "two\r\nlines\n", "&amp;  é\U0001f468", ""]
    urls = ["https://a.example/x?y=1", "ftp://b.example", "https://a.example/a b`c|d", "", None]
    rows = [(i * 10 + j, u, None if t is None else f"<title>{t}</title>x") for i, t in enumerate([*titles, None]) for j, u in enumerate(urls)]
    rows += [(100, "https://a.example", ""), (101, "https://a.example", "x")]
    assert _differences(spark, tmp_path, "markdown_cells", pages=("page_id long, url string, html string", rows)) == ([], [], 0)


def test_entropies_of_ids(spark, tmp_path):
    dyadic = "a" * 128 + "b" * 64 + "c" * 32 + "d" * 16 + "e" * 8 + "f" * 4 + "g" * 2 + "hi"
    texts = [None, "", "a", "aaaa", "ab", " \n", "\U0001f468\u200d\U0001f469 e\u0301", "\x00a", dyadic, "word " * 4000]
    rows = [*enumerate(texts), (4, "bcd"), (4, None), (None, "xyz"), (None, "xxy")]
    assert _differences(spark, tmp_path, "char_entropy", documents=("doc_id long, text string", rows)) == ([], [], 0)
