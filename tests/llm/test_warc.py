import hashlib

import pytest

from docquarry.llm import warc
from docquarry.llm.shared import fresh_path

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    out, best = [], {}
    data = [(p, (h or "").encode()) for p, _, h in rows]
    for p, b in data:
        if p is not None:
            best[b] = max(best.get(b, p), p)
    for p, b in data:
        again = len(b) >= 1000 and b in best and p != best[b]
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", best[b] if again else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    rows += [(p + 10_000, u + "?copy", h) for p, u, h in rows[::3]] + [(20_000, "http://a.example/", "small"), (20_001, "http://a.example/", "small")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(warc.archive(spark, df)) == brute(rows)


def test_odd_rows(spark):
    big = "é日\r\n\r\nWARC/1.1\r\n" * 200
    rows = [(1, None, None), (2, "", ""), (3, "not a url \t\n", big), (4, "http://[bad", big), (5, "http://WWW.Example.com:80/a b?x=1#f", "x" * 999), (None, "http://e.com", big), (7, "http://e.com", "x" * 2_000_000), (8, "http://e.com", "x" * 2_000_000), (-9, "http://ü.de/ñ", "x" * 999)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as key", "2 as refers_to", "3 as digest")
    assert found(warc.archive(spark, df)) == brute(rows)
    twice = df.where("page_id = 7").union(df.where("page_id = 7"))
    assert [r[3] for r in found(warc.archive(spark, twice))] == ["response"] * 2
    assert warc.archive(spark, df.where("false")).count() == 0


def test_index_finds_only_its_keys(spark):
    rows = [(i, f"http://h{i % 7}.example.org/p{i}", f"body {i} " * 200) for i in range(1500)]
    folder = fresh_path(spark, "t")
    pages = warc.with_revisits(spark.createDataFrame(rows, SCHEMA))
    parts = warc.write_index(spark, warc.write_archives(spark, pages, folder + "/w"), folder + "/i")
    index, files = warc.CaptureIndex(parts), warc.Files()
    for i in (0, 1, 699, 1499):
        places = list(index.find(warc.capture_key(rows[i][1], i)))
        assert len(places) == 1
        assert warc.parse(files.read(*places[0])).payload.decode() == rows[i][2]
    assert not list(index.find("com,nowhere)/ 1")) and not list(index.find("")) and not list(index.find("zzz"))
    whole = warc.look_up(spark, spark.createDataFrame([(warc.capture_key(rows[5][1], 5),)], "key string"), parts, text=True).collect()
    assert [bytes(r.payload).decode() for r in whole] == [rows[5][2]]


def test_damage_is_noticed():
    member = warc.record("http://a/", 1, b"payload", None)
    import zlib

    data = zlib.decompress(member, 31).replace(b"payload", b"paYload")
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        warc.parse(pack.compress(data) + pack.flush())


def test_reversed_hosts():
    assert warc.reversed_host("https://www.B.example.com/x?y=1#z") == "com,example,b)/x?y=1"
    assert warc.reversed_host("http://a.org") == "org,a)/"
    assert warc.reversed_host(None) == ""
