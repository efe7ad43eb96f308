import gzip
from hashlib import sha1

import pytest

from tidemark.llm.warc import read_warc, write_warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: text/html\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
HTML = [
    "<p>one</p>", "", None, "x" * 1500, "x" * 1500, "x" * 1500, "é🙂" * 400, FAKE, "a\r\n" + FAKE + FAKE + "b", "\r\nWARC/1.0\r\n\r\n", "WARC/1.1" + "\r\n" * 5, "z" * 900, "z" * 900,
    "\r\n\r\n" + FAKE * 30 + "\r\n\r\n", "line\n" * 500,
]
PAGES = [(i, f"http://e.org/{i} a\r\nX: y" if i % 2 else None, h, "t") for i, h in enumerate(HTML, -3)]


def want(rows):
    out = []
    for p, _, h, _ in rows:
        data = (h or "").encode()
        same = [q for q, _, g, _ in rows if (g or "").encode() == data and q is not None]
        first = max(same) if len(data) >= 1000 and same else p
        out.append((p, len(data), sha1(data).hexdigest(), "response" if p == first else "revisit", None if p == first else first))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("split", "segment"), [("128m", 64 << 20), ("700", 64 << 20), ("700", 900), ("300", 100)])
def test_round_trip_over_splits_and_segments(spark, tmp_path, split, segment):
    top = f"file://{tmp_path}/w"
    write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").coalesce(2), top)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert rows(read_warc(spark, top, segment=segment)) == want(PAGES)
        whole = {r.page_id: bytes(r.payload).decode() for r in read_warc(spark, top, payloads=True, segment=segment).collect() if r.record_type == "response"}
        assert whole == {p: h or "" for (p, _, h, _), w in zip(PAGES, [x for x in PAGES], strict=True) if (p, "response") in {(a, d) for a, _, _, d, _ in want(PAGES)}}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_gzip_null_ids_repeats_and_nothing(spark, tmp_path):
    data = [(1, "u", "q" * 1200, "t"), (1, "u", "q" * 1200, "t"), (None, None, "q" * 1200, "t"), (None, None, "r" * 1200, "t")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, digest string")
    write_warc(df, f"file://{tmp_path}/g", compression="gzip")
    assert rows(read_warc(spark, f"file://{tmp_path}/g")) == want(data)
    write_warc(df.limit(0), f"file://{tmp_path}/n")
    assert read_warc(spark, f"file://{tmp_path}/n").collect() == []


def test_foreign_and_truncated_archives(spark, tmp_path):
    (tmp_path / "f").mkdir()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    raw = b"WARC/1.0\r\nwarc-type: resource\r\nContent-Length: 4\r\nContent-Type: image/png\r\n\r\n\xff\xfe\x00\r\r\n\r\n"
    cut = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 400\r\n\r\nshort"
    (tmp_path / "f/a.warc").write_bytes(info + raw + info + cut)
    (tmp_path / "f/b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(raw))
    (tmp_path / "f/c.warc").write_bytes(b"junk" + info)
    got = read_warc(spark, f"file://{tmp_path}/f").collect()
    assert sorted(r.record_type for r in got if r.record_type != "response") == ["resource"] * 2 + ["warcinfo"] * 3
    assert {r.payload_digest for r in got if r.record_type == "resource"} == {sha1(b"\xff\xfe\x00\r").hexdigest()}


def test_a_very_long_page(spark, tmp_path):
    from hashlib import sha1

    html = "WARC/1.1\r\n" + "<p>word é</p>\r\n" * 300_000
    rows = [(1, "u", html), (2, "v", html), (3, "w", "short")]
    write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_warc(spark, f"file://{tmp_path}/a").collect()}
    n, d = len(html.encode()), sha1(html.encode()).hexdigest()
    assert got == {1: (n, d, "revisit", 2), 2: (n, d, "response", None), 3: (5, sha1(b"short").hexdigest(), "response", None)}
