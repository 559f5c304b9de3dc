"""Metadata and plain-text records derived from WARC responses, each linked with the response it comes from.

For each response two records are made: a ``metadata`` record (title, links, and the source's headers and digest as
warc-fields) and a ``conversion`` record (the page's text). Both name the response in WARC-Refers-To, keep its target URI and
date, and carry the digest of their own block. Digests and headers are built by Spark; one pandas function per
batch takes the HTML apart. There is no shuffle, so a task's memory is one batch, and a lost task is simply run again.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemill.functions.columns import col

CRLF = "\r\n"
CAPTURED = "1970-01-01T00:00:00Z"
_INSIDE = r"""(?:[^>"']|"[^"]*"|'[^']*')*+"""
_UNSEEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|title)\b{_INSIDE}>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(rf"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form"
                    rf"|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b{_INSIDE}>", re.I)
_TAG = re.compile(rf"<[a-zA-Z/!?]{_INSIDE}>|<[a-zA-Z/!?][^>]*>")
_TITLE = re.compile(rf"<title\b{_INSIDE}>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_LINK = re.compile(r"""<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
EXTRACT = "title string, text string, links array<string>"


def extract(page: str | None, url: str | None) -> tuple[str, str, list[str]]:
    """Title, text (a line for each block with any) and absolute links, first mention first, of a whole page."""
    page = page or ""
    found = _TITLE.search(page)
    title = " ".join(html.unescape(found[1]).split()) if found else ""
    seen = _UNSEEN.sub(" ", page)
    links = dict.fromkeys(_absolute(url or "", html.unescape(next(filter(None, m.groups()), "").strip())) for m in _LINK.finditer(seen))
    text = html.unescape(_TAG.sub("", _BLOCK.sub("\x00", seen).replace("\n", " ")))
    lines = (" ".join(line.split()) for line in text.split("\x00"))
    return title, "\n".join(filter(None, lines)), [u for u in links if u]


def _absolute(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:  # what is no URL stays as written
        return link


def _urn(*parts: Column) -> Column:
    """A record identifier that follows from the record's content: the same in every run."""
    name = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _lines(*fields: tuple[str, Column]) -> Column:
    """``name: value`` lines; a null value leaves its line out. Line ends inside a value become blanks."""
    return F.concat_ws(CRLF, *[F.concat(F.lit(f"{n}: "), F.regexp_replace(v.cast("string"), "[\r\n]+", " ")) for n, v in fields])


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              captured: str = CAPTURED, content_type: str = "text/html; charset=utf-8") -> DataFrame:
    """Pages as response records: source_id, record_id, target_uri, date, content_type, payload, payload_digest, length."""
    payload = F.coalesce(col(html_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).alias("source_id"), col(url_col).cast("string").alias("target_uri"), F.lit(captured).alias("date"),
                        F.lit(content_type).alias("content_type"), payload.alias("payload"), _digest(payload).alias("payload_digest"),
                        F.octet_length(payload).cast("bigint").alias("length"))
    return rows.withColumn("record_id", _urn(F.lit("response"), F.col("source_id"), F.col("target_uri"), F.col("payload_digest")))


def derive(responses: DataFrame) -> DataFrame:
    """Two records for each response: source_id, warc_type, record_id, refers_to, target_uri, source_digest, header, block,
    block_digest, length.

    A response without payload gives an empty conversion block and metadata without title and links; one without a URL
    gives records without a target URI and keeps relative links as they are. Repeated rows give records with the same
    identifiers. The order within a response is metadata, then conversion.
    """
    def take_apart(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract(p, u) for p, u in zip(pages, urls)], columns=["title", "text", "links"])

    taken = responses.withColumn("found", F.pandas_udf(take_apart, EXTRACT)("payload", "target_uri"))
    title = F.when(F.col("found.title") != "", F.col("found.title"))
    outlinks = F.transform("found.links", lambda u: F.concat(F.lit("outlink: "), F.regexp_replace(u, "[\r\n]+", " ")))
    about = F.concat_ws(CRLF, _lines(
        ("title", title), ("source-content-type", F.col("content_type")), ("source-content-length", F.col("length")),
        ("source-payload-digest", F.col("payload_digest"))), F.array_join(F.when(F.size(outlinks) > 0, outlinks), CRLF))
    made = F.array(F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("kind"), about.alias("block")),
                   F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("kind"),
                            F.col("found.text").alias("block")))
    rows = taken.select("source_id", F.col("record_id").alias("refers_to"), "target_uri", "date",
                        F.col("payload_digest").alias("source_digest"), F.inline(made))
    rows = rows.withColumn("block_digest", _digest(F.col("block"))).withColumn("length", F.octet_length("block").cast("bigint"))
    rows = rows.withColumn("record_id", _urn(F.col("warc_type"), F.col("refers_to"), F.col("block_digest")))
    header = F.concat_ws(CRLF, F.lit("WARC/1.1"), _lines(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")),
        ("X-Source-Payload-Digest", F.col("source_digest")), ("Content-Type", F.col("kind")), ("Content-Length", F.col("length"))))
    return rows.select("source_id", "warc_type", "record_id", "refers_to", "target_uri", "source_digest", header.alias("header"),
                       "block", "block_digest", "length")


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzip-compressed WARC files, one for each partition. The text writer's line end closes each record."""
    whole = F.concat(F.col("header"), F.lit(CRLF * 2), F.col("block"), F.lit(CRLF))
    records.select(whole.alias("value")).write.option("lineSep", CRLF).option("compression", "gzip").text(path)


def op3_warc_derive(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return derive(responses(pages)).withColumnRenamed("source_id", "page_id")
