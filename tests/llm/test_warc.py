import tempfile

from warung.llm import warc as M

PAGES = [(1, "http://a/x", "<p>" + "z" * 200), (2, "http://a/é y\n", "<p>" + "z" * 200), (3, None, None), (4, "u", ""), (5, "u", "short"),
         (6, "u", "short"), (7, "http://b", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n" * 9), (8, "http://c", "ü€" * 100), (9, "http://c", "ü€" * 100)]


def archive(spark, rows=PAGES, parts=3):
    path = tempfile.mkdtemp(prefix="warung-warc-") + "/w"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS payload", "1 AS _first")
    M.write_warc(df.repartition(parts), path)
    return path


def test_round_trip(spark):
    got = {r.record_id: r for r in M.read_warc(spark, archive(spark)).collect()}
    assert len(got) == len(PAGES)
    first = {}
    for i, url, html in PAGES:
        r = got[f"{M.ID}{i}"]
        body = html or ""
        key = body if len(body.encode()) >= 100 else (i, body)
        leader = first.setdefault(key, i)
        assert r.payload_bytes == len(body.encode())
        if leader == i:
            assert r.record_type == "response" and r.payload == body and r.payload_sha256 == r.payload_digest and r.refers_to is None
        else:
            assert r.record_type == "revisit" and r.payload == "" and r.refers_to == f"{M.ID}{leader}"
            assert r.payload_digest == got[f"{M.ID}{leader}"].payload_digest
        assert (r.target_uri is None) == (url is None)


def test_predicates_are_pushed_and_payloads_skipped(spark):
    path = archive(spark)
    some = M.read_warc(spark, path).where("record_type = 'revisit'")
    assert {r.record_id for r in some.collect()} == {f"{M.ID}{i}" for i in (2, 9)}
    plain = M.read_warc(spark, path, payloads=False).where(f"record_id IN ('{M.ID}1', '{M.ID}8')").collect()
    assert len(plain) == 2 and all(r.payload is None for r in plain)
    reader = M.WarcReader({"files": "a"})
    left = list(reader.pushFilters([M.EqualTo(("record_type",), "response"), M.EqualTo(("payload",), "x")]))
    assert len(left) == 1 and reader.wanted == [("record_type", ("response",))]


def test_empty_table_and_repeated_rows(spark):
    assert M.read_warc(spark, archive(spark, [])).count() == 0
    twice = archive(spark, [PAGES[0], PAGES[0], PAGES[1]])
    assert sorted(r.record_type for r in M.read_warc(spark, twice).collect()) == ["response", "response", "revisit"]


def test_record_members_and_plain_archives():
    import gzip
    import io
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for raw in (one * 3, gzip.compress(one) * 3, gzip.compress(one * 3)):
        s = M._Stream(io.BytesIO(raw), room=7)
        bodies = []
        while (h := s.head()) is not None:
            bodies.append(s.body(int(M.parse_headers(h)["content-length"]), True))
        assert bodies == [b"abc"] * 3


def test_pages_without_an_id(spark):
    import duckdb

    from warung.llm import oracle, queries
    rows = PAGES + [(None, "http://n", "<p>" + "z" * 200), (None, "http://n", "short"), (None, None, None), (None, "u", "y" * 150), (None, "u", "y" * 150)]
    got = M.read_warc(spark, archive(spark, rows)).collect()
    none = sorted((r.record_type, r.payload, r.refers_to or "") for r in got if r.record_id is None)
    assert len(got) == len(rows)
    assert none == [("response", "", ""), ("response", "short", ""), ("response", "y" * 150, ""), ("response", "y" * 150, ""), ("revisit", "", f"{M.ID}1")]
    folder = tempfile.mkdtemp(prefix="warung-warc-")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    df = queries.op4_warc(spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    rel = con.sql(oracle.SQL["op4_warc"])
    at = [rel.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in at)) for r in rel.fetchall())
