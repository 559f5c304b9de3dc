import gzip
import os
from hashlib import sha256
from html.parser import HTMLParser
from urllib.parse import urljoin

from tidemill.llm.warc_derive import derive, extract, responses, write_warc

BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
             "header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())


class Brute(HTMLParser):
    """The same page by the standard parser."""

    def __init__(self):
        super().__init__()
        self.title, self.parts, self.links, self.unseen = [], [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript", "title"):
            self.unseen.append(tag)
            self.parts.append(" ")
        elif tag in BLOCKS:
            self.parts.append("\x00")
        if tag == "a":
            self.links += [v.strip() for k, v in attrs if k == "href" and v]

    def handle_endtag(self, tag):
        if self.unseen and tag == self.unseen[-1]:
            self.unseen.pop()
        elif tag in BLOCKS:
            self.parts.append("\x00")

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data.replace("\n", " "))
        elif self.unseen[-1] == "title":
            self.title.append(data)

    def read(self, page, url):
        self.feed(page)
        self.close()
        lines = (" ".join(x.split()) for x in "".join(self.parts).split("\x00"))
        return " ".join("".join(self.title).split()), "\n".join(filter(None, lines)), list(dict.fromkeys(urljoin(url, u) for u in self.links))


def test_pages_are_read_as_the_standard_parser_does(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        assert extract(r.html, r.url) == Brute().read(r.html, r.url)


def test_odd_pages():
    assert extract(None, None) == ("", "", []) and extract("", "x") == ("", "", [])
    assert extract("<p>a<b>b</b>&amp;c<script>if (a<b) '</p>'", "u") == ("", "ab&c", [])
    assert extract("<a href='/x?a=1&amp;b=2'>y</a><a href=z>w</a><a href=\"\">v</a>", "http://h/p/") == ("", "ywv", ["http://h/x?a=1&b=2", "http://h/p/z", "http://h/p/"])
    assert extract("<TITLE>a\n b</TITLE><p title='x > y'>t</p> 1 < 2", None) == ("a b", "t\n1 < 2", [])
    assert extract("<p title=\"open>text</p>after", None)[1].endswith("after")
    assert extract("x" * 200_000 + "<p " * 5000, None)[1].startswith("xxx")


def test_records_are_linked(spark):
    rows = [(1, "http://h/a", "<title>T</title><p>one</p><a href='b'>two</a>", "q"), (2, None, None, "q"), (2, None, None, "q"), (None, "http://h/c", "", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    source = responses(pages)
    got = derive(source).collect()
    assert len(got) == 2 * len(rows)
    ids = {r.record_id: r for r in source.collect()}
    for r in got:
        of = ids[r.refers_to]
        assert r.source_digest == of.payload_digest == "sha256:" + sha256(of.payload.encode()).hexdigest()
        assert r.block_digest == "sha256:" + sha256(r.block.encode()).hexdigest() and r.length == len(r.block.encode())
        assert f"WARC-Refers-To: {of.record_id}" in r.header.split("\r\n") and f"WARC-Type: {r.warc_type}" in r.header
        assert ("WARC-Target-URI" in r.header) == (of.target_uri is not None)
        if r.warc_type == "metadata":
            assert f"source-payload-digest: {of.payload_digest}" in r.block and f"source-content-type: {of.content_type}" in r.block
    one = {r.warc_type: r for r in got if r.source_id == 1}
    assert one["conversion"].block == "one\ntwo" and "title: T\r\n" in one["metadata"].block and one["metadata"].block.endswith("outlink: http://h/b")
    assert len({r.record_id for r in got}) == 6  # the repeated row's records are the same records
    assert derive(responses(pages.limit(0))).count() == 0


def test_files_hold_the_records(spark, tmp_path):
    records = derive(responses(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")))
    write_warc(records, str(tmp_path / "w"))
    found = {}
    for name in os.listdir(tmp_path / "w"):
        if name.endswith(".gz"):
            data = gzip.open(tmp_path / "w" / name).read()
            while data:
                head, _, data = data.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                size = int(fields["Content-Length"])
                found[fields["WARC-Record-ID"]] = data[:size].decode()
                assert data[size:size + 4] == b"\r\n\r\n"
                data = data[size + 4:]
    assert found == {r.record_id: r.block for r in records.collect()}
