"""WARC derivatives: every response becomes a metadata record and a conversion record with its plain text.

A row of `pages` is a response whose block is the page itself: the table has no HTTP headers and no dates, so block and
payload digest are equal, and no WARC-Date is made up. Both records keep the response's uri and digests, refer to
its record id, and carry the digest of their own block. Digests are SHA-1 in base 32; ids are name-based UUIDs over page
id, uri and block digest, so a rerun gives the same records.

Text leaves out scripts, styles, templates and comments; elements that start a line do so, and white space is folded. Pages
are read from front to back in linear time, and no markup is an error: a comment, declaration or tag without an end takes
the rest of the page, `<` before anything else is text, an attribute given twice counts once, and a reference to a
character beyond Unicode gives U+FFFD.

Edge cases: a null page counts as empty and gives both records; a null uri is left out of the headers. Control characters,
spaces and line separators of a uri are percent-escaped in the header, and kept in target_uri and the metadata's JSON. Repeated rows give
equal records, one pair a row. An empty table gives an empty result. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, warc_type string, record_id string, refers_to string, target_uri string, source_block_digest string, source_payload_digest string, block_digest string, headers string, block string"
_SKIPPED = {"script", "style"}
_LINES = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table td th title tr ul".split())


#: What may stand between two attributes, a name, and a value if there is one.
_GAP, _NAME = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*")
_VALUE = re.compile(r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|(?!["'])([^\s>]*))""")
_OPEN = re.compile(r"\s*=\s*[\"']")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: Elements whose content is text up to their own end tag.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "textarea", "title")}
#: Numeric references beyond Unicode.
_BEYOND = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,});?")
_ZEROS = re.compile(r"&#([xX]?)0{8,}")


def characters(text: str) -> str:
    """The text with its character references resolved; those beyond Unicode become U+FFFD."""
    return unescape(_BEYOND.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", text))) if "&" in text else text


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes from a place within a tag, each by its first value, and the place after the tag; -1 if it has no end."""
    found: dict[str, str] = {}
    while True:
        at = _GAP.match(html, at).end()
        if at == len(html):
            return found, -1
        if html[at] == ">":
            return found, at + 1
        name = _NAME.match(html, at)
        value = _VALUE.match(html, name.end())
        if value is None and _OPEN.match(html, name.end()):
            return found, -1
        at = value.end() if value else name.end()
        found.setdefault(name[0].lower(), characters(next((v for v in value.groups() if v is not None), "")) if value else "")


def read(html: str) -> tuple[str, dict]:
    """The text, and title, language and links, in one pass from front to back: no place is looked at twice but to find
    where a comment, a tag or a raw text ends, and where none does, the page ends."""
    parts: list[str] = []
    title: list[str] = []
    links: list[str] = []
    lang, hidden, at = None, 0, 0

    def data(text: str) -> None:
        if not hidden:
            # A line break of the source is white space only.
            parts.append(characters(text).replace("\n", " "))

    while at < len(html):
        sign = html.find("<", at)
        if sign < 0 or sign > at:
            data(html[at : sign if sign > 0 else len(html)])
            at = sign if sign > 0 else len(html)
            continue
        tag = _TAG.match(html, at)
        if tag is None:
            if html.startswith("<!--", at):
                # A comment may end at once.
                end = at + 5 if html.startswith("<!-->", at) else html.find("-->", at + 4) + 3
                at = end if end > 2 else len(html)
            elif html[at + 1 : at + 2] in ("!", "?", "/"):
                end = html.find(">", at)
                at = end + 1 if end > 0 else len(html)
            else:
                data("<")
                at += 1
            continue
        closing, name = bool(tag[1]), tag[2].lower()
        given, at = _attributes(html, tag.end())
        if at < 0:
            break
        if name in _LINES:
            parts.append("\n")
        if name == "template":
            hidden = max(0, hidden - 1) if closing else hidden + 1
        if closing:
            continue
        if name == "a" and given.get("href"):
            links.append(given["href"])
        if name == "html":
            lang = lang or given.get("lang") or None
        if name in _RAW:
            end = _RAW[name].search(html, at)
            inner = html[at : end.start() if end else len(html)]
            at = end.start() if end else len(html)
            if name not in _SKIPPED:
                data(inner)
            if name == "title":
                title.append(characters(inner))
    lines = (" ".join(line.split()) for line in "".join(parts).split("\n"))
    return "\n".join(line for line in lines if line), {"title": " ".join(" ".join(title).split()), "lang": lang, "links": links}


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, page_id: int | None, uri: str | None, block_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, json.dumps([kind, page_id, uri, block_digest]))}>"


#: Characters that would end or hide a header line.
_CONTROLS = re.compile("[\\x00-\\x20\\x7f-\\x9f\u2028\u2029]")


def header_value(text: str) -> str:
    """The text on one line: control characters, spaces and line separators as percent escapes of their UTF-8."""
    return _CONTROLS.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def derivatives(page_id: int | None, uri: str | None, html: str | None) -> list[tuple]:
    """The metadata and the conversion record of a response, as rows of SCHEMA."""
    source = (html or "").encode("utf-8", "surrogatepass")
    of = digest(source)
    origin = record_id("response", page_id, uri, of)
    text, found = read(html or "")
    meta = json.dumps({"source": {"WARC-Type": "response", "WARC-Record-ID": origin, "WARC-Target-URI": uri, "WARC-Block-Digest": of, "WARC-Payload-Digest": of, "Content-Length": len(source)}, **found}, ensure_ascii=False)
    out = []
    for kind, mime, block in (("metadata", "application/json", meta), ("conversion", "text/plain", text)):
        raw = block.encode("utf-8", "surrogatepass")
        own, name = digest(raw), record_id(kind, page_id, uri, of)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Refers-To", origin), ("WARC-Target-URI", None if uri is None else header_value(uri)), ("WARC-Block-Digest", own), ("Content-Type", mime), ("Content-Length", len(raw))]
        headers = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
        out.append((page_id, kind, name, origin, uri, of, of, own, headers, block))
    return out


def build(pages: DataFrame) -> DataFrame:
    """Two rows of SCHEMA for every row of pages (page_id, url, html)."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [r for x in zip(*(c.to_pylist() for c in part.columns), strict=True) for r in derivatives(*x)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*rows, strict=True))], names)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
