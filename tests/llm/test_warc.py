import hashlib

import pandas as pd
from pyspark.sql import functions as F

from meterloom.llm import queries, warc_index

SF = "/root/testdata/sf0.001"


def expected(pages):
    first = {}
    for i, html in pages:
        if len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = {}
    for i, html in pages:
        raw, to = (html or "").encode(), first.get(html, i)
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if to == i else "revisit", None if to == i else to)
    return out


def got(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def test_query(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    df = queries.op8_warc_index(spark, SF)
    assert got(df) == expected(list(zip(pages.page_id.tolist(), pages.html))) and df.count() == len(pages)


def test_edges(spark, monkeypatch, tmp_path):
    long = "<p>" + "é" * 60
    rows = [(1, "http://A.example.com:80/x?q=1#top", long), (2, "https://u@a.example.com/x?q=1", long), (3, None, None), (4, "not a url\r\nX: y", ""),
            (5, "http://b.example.com", "short"), (6, "http://b.example.com", "short"), (7, "", long)] + [(i, "http://hot.example.com/same", long + str(i % 3)) for i in range(20, 60)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    out = warc_index.round_trip(pages)
    assert got(out) == expected([(i, h) for i, _, h in rows]) and out.count() == len(rows)
    assert warc_index.round_trip(pages.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "http://n.example.com", long), (None, "http://n.example.com", None), (9, "http://n.example.com", long)], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in warc_index.round_trip(nulls).collect()) == [("9", "response", "None"), ("None", "response", "None"), ("None", "revisit", "9")]


def test_blocks_and_directory(tmp_path, monkeypatch):
    import gzip
    monkeypatch.setattr(warc_index, "LINES", 3)
    rows = [f"k{i // 4:03d} {i} f {i * 10} 10" for i in range(40)]
    at, directory, body = 0, [], b""
    for i in range(0, 40, 3):
        packed = gzip.compress("\n".join(rows[i:i + 3]).encode())
        directory.append(f"{rows[i].split(' ')[0]} {at} {len(packed)}")
        at, body = at + len(packed), body + packed
    (tmp_path / "s.cdx.gz").write_bytes(body)
    (tmp_path / "s.idx").write_text("\n".join(directory))
    own = warc_index.Shard(str(tmp_path / "s"))
    for k in range(10):
        assert [int(x[1]) for x in own.captures(f"k{k:03d}".encode())] == list(range(4 * k, 4 * k + 4))
    assert not list(own.captures(b"k0")) and not list(own.captures(b"zz"))


def test_url_keys(spark):
    urls = spark.createDataFrame([("http://WWW.Example.org:8080/A/b?c#d",), ("mailto:x",), (None,), ("https://x.y",), ("http:///p",)], "u string")
    assert [r[0] for r in urls.select(warc_index.url_key(F.col("u"))).collect()] == ["org,example,www)/A/b?c", ")mailto:x", "", "y,x)", ")http:///p"]
