"""WARC derivatives held against plain Python."""

from __future__ import annotations

import base64
import hashlib
import json
import time
from html.parser import HTMLParser

import pytest

from tests.conftest import SF
from trailspark.llm import queries, warc


def sha(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_every_page_gives_both_records(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    rows = queries.QUERIES["op5_warc_derivatives"](spark, SF).collect()
    assert sorted((r.page_id, r.warc_type) for r in rows) == sorted((p.page_id, k) for p in pages for k in ("metadata", "conversion"))
    page = {p.page_id: p for p in pages}
    refers = {}
    for r in rows:
        p = page[r.page_id]
        assert r.source_block_digest == r.source_payload_digest == sha(p.html or "") and r.block_digest == sha(r.block) and r.target_uri == p.url
        fields = dict(line.split(": ", 1) for line in r.headers.split("\r\n")[1:-2])
        assert fields["WARC-Refers-To"] == r.refers_to and int(fields["Content-Length"]) == len(r.block.encode()) and fields["WARC-Block-Digest"] == r.block_digest
        refers.setdefault(r.page_id, set()).add(r.refers_to)
        if r.warc_type == "metadata":
            assert json.loads(r.block)["source"]["WARC-Record-ID"] == r.refers_to
    assert all(len(x) == 1 for x in refers.values()) and len({r.record_id for r in rows}) == len(rows)


def test_text_and_edge_cases(spark):
    html = '<html lang="de"><title>A &amp; B</title><script>var t="</p>";</script><p>one\n two<b>three</b><!-- no --><div>x &lt; y<a href="/z">z</a>'
    rows = [(1, "http://a/", html), (2, None, None), (None, "http://b/", ""), (1, "http://a/", html)]
    got = warc.build(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {(r.page_id, r.target_uri): r.block for r in got if r.warc_type == "conversion"}
    assert len(got) == 8 and text == {(1, "http://a/"): "A & B\none twothree\nx < yz", (2, None): "", (None, "http://b/"): ""}
    meta = json.loads(next(r.block for r in got if r.page_id == 1 and r.warc_type == "metadata"))
    assert (meta["title"], meta["lang"], meta["links"]) == ("A & B", "de", ["/z"])


class Plain(HTMLParser):
    """Text by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], None

    def handle_starttag(self, tag, attrs):
        if tag in warc._LINES:
            self.parts.append("\n")
        if tag in ("script", "style", "template") and self.skip is None:
            self.skip = tag

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        if tag in warc._LINES:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.skip is None:
            self.parts.append(data.replace("\n", " "))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_text_of_all_pages_equals_a_plain_parser(spark, sf):
    for page in spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet").collect():
        plain = Plain()
        plain.feed(page.html or "")
        plain.close()
        lines = (" ".join(line.split()) for line in "".join(plain.parts).split("\n"))
        assert warc.read(page.html or "")[0] == "\n".join(line for line in lines if line), page.page_id


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<![foo[bar]]>x", "x"), ("a<![ x", "a"), ("a < b <3 c<", "a < b <3 c<"), ("a<!-->b<!-- c -->d<!-- e", "abd"), ("x<a href='y", "x"), ("<p a=1 a=2 / =c>x</p q='>'>y", "x\ny"),
        ("<title>a<b>c</title>d", "a<b>c\nd"), ("<script>x</scripty></SCRIPT >z<style>q", "z"), ("<template>a<template>b</template>c</template>d", "d"), ("</template>x", "x"),
        ("&#" + "9" * 5000 + ";&#x" + "f" * 5000 + ";&#" + "0" * 5000 + "65;&amp;&nope", "\ufffd\ufffdA&&nope"), ("<?xml a>b</>c</ d>e", "bce"), ("", ""), ("<", "<"), ("\x00<a\x00>b", "\x00b"),
    ],
)
def test_any_markup_is_read(html, text):
    assert warc.read(html)[0] == text


@pytest.mark.parametrize("piece", ["<a ", "<a href='", "<!--", "<![", "<script>", "<title>", "</", "&#", "<a b=", "<p/", "<template>", "< ", "<a =\"'", "--><!--"])
def test_reading_is_linear(piece):
    html = piece * (1_000_000 // len(piece))
    began = time.process_time()
    warc.read(html)
    assert time.process_time() - began < 4


def test_headers_stay_on_their_lines(spark):
    url = "http://a/\r\nWARC-Type: forged\r\n\r\nx y\u2028\x85\tz"
    rows = warc.build(spark.createDataFrame([(1, url, "x", 3)], "page_id long, url string, html string, warc_type int")).collect()
    assert len(rows) == 2
    for r in rows:
        assert r.target_uri == url and r.headers.count("WARC-Type") == 2 and r.headers.endswith("\r\n\r\n")
        assert len(r.headers.splitlines()) == r.headers.count("\r\n") == 9
        assert "WARC-Target-URI: http://a/%0D%0AWARC-Type:%20forged%0D%0A%0D%0Ax%20y%E2%80%A8%C2%85%09z\r\n" in r.headers
    assert warc.build(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
