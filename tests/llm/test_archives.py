"""ARC to WARC: header lines of both versions, declared lengths, revisits, odd rows."""

import base64
import gzip
import hashlib
import io

import pytest

from postlark.llm import archives as W


def sha1(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc(version, *records):
    name = "old.arc"
    return W.arc_head(version, name, "19990102030405") + b"".join(
        W.arc_record(version, url, date, mime, body, name, 0) for url, date, mime, body in records
    )


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [False, True])
def test_records_are_cut_by_declared_lengths(version, packed):
    odd = b"HTTP/1.0 200 OK\r\n\r\nhttp://x/ 0.0.0.0 19990101000000 text/html 5\nabc\n\n"
    data = arc(version, ("http://a/", "19990102030405", "text/html", odd), ("http://with blank/", "199901020304", "text/plain", b""))
    stream = io.BytesIO(gzip.compress(data[:100]) + gzip.compress(data[100:]) if packed else data)
    got = list(W.arc_records(W._plain(stream)))
    assert [(r[1], r[3], r[4]) for r in got[1:]] == [
        ("http://a/", "19990102030405", "text/html"),
        ("http://with blank/", "199901020304", "text/plain"),
    ]
    assert got[0][1] == "filedesc://old.arc" and [r[5] for r in got[1:]] == [odd, b""]


def test_damaged_archives_are_refused():
    good = arc(1, ("http://a/", "19990102030405", "text/html", b"HTTP/1.0 200 OK\r\n\r\nx"))
    for bad in (good[:-4], b"http://a/ 1.1.1.1 19990102030405 text/html 3\nabc\n", b"nonsense\n"):
        with pytest.raises(ValueError):
            list(W.arc_records(io.BytesIO(bad)))
    with pytest.raises(ValueError):
        list(W.warc_records(io.BytesIO(b"HTTP/1.1 200 OK\r\n\r\n")))


def test_dates_and_kinds():
    assert W.warc_date("19990102030405") == "1999-01-02T03:04:05Z"
    assert W.warc_date("199901020304") == "1999-01-02T03:04:00Z"
    assert W.warc_date("19990102") == "1999-01-02T00:00:00Z"
    record = W._converted("x/a.arc", (3, "dns:a.org", "1.2.3.4", "19990102", "text/dns", b"a.org A"), None)
    (fields, block), = W.warc_records(io.BytesIO(record))
    assert fields["warc-type"] == "resource" and fields["content-type"] == "text/dns"
    assert fields["warc-ip-address"] == "1.2.3.4" and block == b"a.org A"
    assert fields["warc-block-digest"] == f"sha1:{sha1(block)}"


PAGES = [
    (1, "http://a/", "same"), (2, "http://b/ c", "same"), (2, "http://b/ c", "same"), (3, None, None),
    (4, "", ""), (5, "http://e/", "é\r\n\r\nWARC/1.0\r\n\r\n"), (6, "http://f/", "x" * 300_000), (None, "http://g/", "same"),
    (7, "http://h/", "only"), (None, "http://i/", "alone"),
]


def round_trip(spark, tmp_path, pages, least=0, roll=W.ROLL_BYTES):
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, key int")
    made = W.write_arc(frame, f"{tmp_path}/arc", roll=roll)
    return W.read_warc(W.convert_arc(made, f"{tmp_path}/warc", least, roll)).collect()


@pytest.mark.parametrize("roll", [W.ROLL_BYTES, 200])
def test_round_trip(spark, tmp_path, roll):
    got = round_trip(spark, tmp_path, PAGES, roll=roll)
    payload = [(p[2] or "").encode() for p in PAGES]
    want = sorted((str(p[0]), len(b), sha1(b)) for p, b in zip(PAGES, payload))
    assert sorted((str(r.key), r.payload_bytes, r.payload_digest) for r in got) == want
    responses = {r.payload_digest: r for r in got if r.record_type == "response"}
    assert len(responses) == sum(r.record_type == "response" for r in got) == len(set(payload))
    assert responses[sha1(b"same")].key == 2 and responses[sha1(b"")].key == 4
    for r in got:
        if r.record_type == "revisit":
            kept = responses[r.payload_digest]
            assert (r.refers_to, r.refers_to_id) == (kept.key, kept.record_id)
        else:
            assert r.refers_to is None
    assert len({r.record_id for r in got}) == len(PAGES)
    assert {r.url for r in got if r.key == 2} == {"http://b/%20c"}


def test_small_payloads_may_stay_responses(spark, tmp_path):
    got = round_trip(spark, tmp_path, PAGES, least=5)
    assert all(r.record_type == "response" for r in got)


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, tmp_path, []) == []


def test_heads_of_bare_line_feeds():
    from postlark.llm.archives import split_http

    for end in (b"\r\n", b"\n"):
        head = b"HTTP/1.0 200 OK" + end + b"Content-Type: text/html" + end + end
        assert split_http(head + b"body\n\nand\r\n\r\nmore") == (head, b"body\n\nand\r\n\r\nmore")
        assert split_http(head) == (head, b"")
    assert split_http(b"HTTP/1.0 200 OK\nno end") == (b"HTTP/1.0 200 OK\nno end", b"")
