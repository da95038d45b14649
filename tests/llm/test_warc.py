"""WARC derivatives: links between records, bodies as they come, digests, files."""

import base64
import gzip
import hashlib
import html
import io
import json
import zlib

import pyarrow as pa
import pytest

from pagequery.llm import queries, warc


def test_warc_round_trip_and_links(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://h/a/", '<title>T &amp; x</title><script>var a="<p>";</script><p>Hé<br>llo <a href="b?c=1&amp;d">l</a>'), (2, None, None)], "page_id long, url string, html string")
    responses = warc.page_responses(pages)
    made = warc.build_derivatives(responses)
    rows = {(r.headers["WARC-Refers-To"], r.headers["WARC-Type"]): r for r in made.collect()}
    assert len(rows) == 4
    first = next(r for r in responses.collect() if r.page_id == 1)
    name = first.headers["WARC-Record-ID"]
    assert bytes(rows[name, "conversion"].block).decode() == "T & x\nHé\nllo l"
    about = json.loads(bytes(rows[name, "metadata"].block))
    assert about["links"] == ["http://h/a/b?c=1&d"] and about["title"] == "T & x" and about["source_headers"] == dict(sorted(first.headers.items()))
    assert about["block_digest"] == warc.digest(bytes(first.block)) and rows[name, "conversion"].headers["WARC-Refers-To-Payload-Digest"] == about["payload_digest"]
    back = warc.read_warc(warc.write_warc(made, f"file://{tmp_path}/w")).collect()
    strip = lambda r: (tuple(sorted(r.headers.items())), bytes(r.block))
    assert sorted(map(strip, back)) == sorted(map(strip, rows.values()))


def _response(body: bytes, *fields: str, **headers) -> tuple[dict, bytes]:
    block = "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", *fields, "", ""]).encode() + body
    return {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://h/", **headers}, block


def _text(headers, block):
    made = {h["WARC-Type"]: (h, b) for h, b in warc.derive(headers, block)}
    return made["conversion"][1].decode() if "conversion" in made else None, json.loads(made["metadata"][1]), made


def test_bodies_are_decoded():
    page = "<title>T</title><p>Grüße hello</p>".encode()
    chunked = b"5;x=y\r\n" + page[:5] + b"\r\n" + f"{len(page) - 5:X}".encode() + b"\r\n" + page[5:] + b"\r\n0\r\n\r\n"
    deflate = zlib.compressobj(wbits=-15)
    raw = deflate.compress(page) + deflate.flush()
    zipped = gzip.compress(page)
    for body, fields in (
        (page, ()), (chunked, ("Transfer-Encoding: chunked",)), (zipped, ("content-encoding: GZIP",)), (zlib.compress(page), ("Content-Encoding: deflate",)), (raw, ("Content-Encoding: deflate",)),
        (b"%X\r\n%s\r\n0\r\n\r\n" % (len(zipped), zipped), ("Transfer-Encoding: chunked", "Content-Encoding: gzip")), (gzip.compress(zlib.compress(page)), ("Content-Encoding: deflate, gzip",)),
    ):
        text, about, _ = _text(*_response(body, *fields))
        assert text == "T\nGrüße hello" and about["title"] == "T" and about["decoded"]
    text, about, _ = _text(*_response(b"not gzip", "Content-Encoding: gzip"))
    assert text is None and not about["decoded"]
    assert _text(*_response(page, "Content-Encoding: rot13"))[0] is None
    assert _text(*_response(b"5\r\nhe", "Transfer-Encoding: chunked"))[0] == "he"


def test_field_names_count_whatever_their_case():
    headers, block = _response(b"x")
    low = {k.lower(): v for k, v in headers.items()}
    _, _, made = _text(low, block)
    assert made["metadata"][0]["WARC-Refers-To"] == "<urn:uuid:1>" and made["metadata"][0]["WARC-Refers-To-Target-URI"] == "http://h/"


def test_the_sources_digests_are_checked():
    headers, block = _response(b"body")
    good = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    told = lambda **more: _text(headers | more, block)[1]["source_digests_agree"]
    assert told(**{"WARC-Block-Digest": good, "WARC-Payload-Digest": "sha256:" + hashlib.sha256(b"body").hexdigest()}) == {"block": True, "payload": True}
    assert told(**{"warc-block-digest": "sha1:AAAA", "WARC-Payload-Digest": "crc:1"}) == {"block": False, "payload": None}


def test_every_page_against_plain_python(spark):
    """The query's rows, made anew from the pages one by one."""
    from conftest import DATA

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = []
    for r in warc.page_responses(pages).collect():
        for h, b in warc.derive(r.headers, bytes(r.block)):
            want.append((r.page_id, h["WARC-Type"], h["WARC-Record-ID"], h["WARC-Block-Digest"], int(h["Content-Length"]), zlib.crc32(b)))
    got = [(r.page_id, r.warc_type, r.record_id, r.block_digest, r.content_length, r.block_crc32) for r in queries.op5_warc_derivatives(spark, DATA).collect()]
    assert sorted(got) == sorted(want) and len(got) == 2 * pages.count()


def test_odd_records(spark):
    headers, block = _response(b"<p>" + b"long text " * 300_000)
    rows = [(headers, block), (headers, None), (None, block), ({"WARC-Type": "request"}, b"x"), ({"WARC-Type": "response"}, b""), (headers, block), (headers | {"none": None}, b"no http at all")]
    df = spark.createDataFrame(rows, "headers map<string,string>, block binary").selectExpr("*", "1 AS path", "2 AS page_id")
    made = warc.build_derivatives(df).collect()
    assert len(made) == 8 and max(len(r.block) for r in made) > 2_900_000
    assert warc.build_derivatives(df.limit(0)).count() == 0 and warc.read_warc(warc.write_warc(warc.build_derivatives(df.limit(0)))).count() == 0


def test_plain_references_are_joined_as_others_are(monkeypatch):
    """The short way gives what ``urljoin`` gives, and is taken for plain references."""
    from urllib.parse import urljoin

    bases = ["http://h.example/a/b?q=1", "https://h.example:81", "HTTP://H.example/", "", "x", "ftp://h/a", "http://h.example?x", "http://[bad", "http://h.example/a;p/../c\n", "//h/a"]
    refs = ["", "/", "/a", "/a/../b", "/a/./b", "/a//b", "/a/b.html?x=1&y=", "/a?", "/a#f", "/a;p", "//h/x", "a", "../a", "http://o.example/a/b", "http://o.example", "https://o.example/a?x=1", "HTTP://o.example/a", "http://o.example/a/../b", "http://o.example/a?", "/a ", " /a", "/\u00e9", "/..", "/.a", "/a.", "/a..", "http://o.example/\n", "mailto:x"]
    for base in bases:
        origin = warc._ORIGIN.match(base)
        for ref in refs:
            try:
                want = urljoin(base, ref.strip())
            except ValueError:
                want = ref
            assert warc._absolute(base, ref, origin and origin[1]) == want, (base, ref)

    def never(*_):
        raise AssertionError

    monkeypatch.setattr(warc, "urljoin", never)
    page = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<a href=/a/b.html>x</a><a href=\"https://o.example/c?d=1\">y</a>"
    about = warc.derive({"WARC-Type": "response", "WARC-Target-URI": "https://h.example/p/q"}, page)[0][1]
    assert b'"links": ["https://h.example/a/b.html", "https://o.example/c?d=1"]' in about


def test_a_page_is_hashed_once_for_its_id(spark):
    """What is left to run when the files are written reads ids from the pages; Spark works a hash out as often as the plan names it."""
    from conftest import DATA

    plan = queries.op5_warc_derivatives(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1
    first = warc.page_responses(spark.read.parquet(f"{DATA}/pages.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert first.count("sha2(") == 1


def test_links_with_letters_of_any_script_take_the_short_way(monkeypatch):
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(warc, "urljoin", never)
    origin = "https://h.example"
    for ref in ("/Ci\u00f3nue", "/m\u00e9,n/%C3%A9.", "/\u6f22\u5b57?q=\u00e9,1"):
        assert warc._absolute(origin + "/x", ref, origin) == origin + ref


def test_tags_go_in_one_pass_as_in_two():
    pages = ["", "a", "<p>x</P>y", "<b>x</b>", "1 < 2 <p>x", "<b <p> x>", "a<>b</>c< p>d", "<blockquotes>x<blockquote-s>y", "<h1\nid=a>x</h1", "<?xml?><!doctype html>x", "<9>x<\u00e9>y", '<a href="<p>">x', "<\u017fection>x", "a\u00a0 b\t c\x1c<br>\u3000d  e<li> "]
    for page in pages:
        plain = html.unescape(warc._TAG.sub("", warc._BREAK.sub("\n", page)))
        assert warc.plain_text(page) == "\n".join(line for x in plain.split("\n") if (line := " ".join(x.split()))), page


def test_batches_of_records_and_back():
    rows = [({"a": "1", "b": "\u00e9"}, b"x"), ({}, b""), ({"a": ""}, b"y" * 9)] * 3
    (batch,) = warc._batches(iter(rows))
    assert batch.schema == warc._RECORD and batch.equals(pa.RecordBatch.from_pylist([{"headers": list(h.items()), "block": b} for h, b in rows], schema=warc._RECORD))
    assert list(warc._records(batch)) == rows and list(warc._records(batch.slice(2, 4))) == rows[2:6] and list(warc._records(batch.slice(1, 0))) == [] and list(warc._batches([])) == []
    odd = pa.RecordBatch.from_pylist([{"headers": None, "block": b"x"}, {"headers": [("a", None)], "block": None}], schema=warc._RECORD)
    assert list(warc._records(odd)) == [(None, b"x"), ({"a": None}, None)]


def test_gzip_members_of_any_make():
    rows = [({"WARC-Type": "x", "Content-Length": str(n)}, bytes(range(256)) * (n // 256)) for n in (0, 256, 768_000)]
    plain = [warc.serialize(*row) for row in rows]
    read = lambda data: list(warc.parse_records(io.BufferedReader(warc._Stream(warc._inflated(io.BytesIO(data))))))
    members = b"".join(map(gzip.compress, plain))
    for data in (members, gzip.compress(b"".join(plain)), members + bytes(70_000), gzip.compress(plain[0]) + b"\0" + gzip.compress(plain[1] + plain[2])):
        assert read(data) == rows
    assert read(b"") == read(gzip.compress(b"")) == []
    with pytest.raises(EOFError):
        read(members[:-5])
    with pytest.raises(zlib.error):
        read(members + b"more")
