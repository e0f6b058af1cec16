"""WARC derivatives: every response record becomes a metadata and a conversion record, linked with it.

Both derivatives name their source in WARC-Refers-To (with its target URI and date) and keep its block and payload digests; the
metadata record's block lists the source's HTTP status and headers, title and links, and the conversion record's block is the page's plain text.
Identifiers follow from the source's identifier and the kind of derivative, so a repeated task or run gives the same records.

All of it is one pass over the rows, without a shuffle; pages are parsed one at a time by one scanner that is linear in the page, however broken.

Defined results: a very long page is held whole by its task; a null payload or header block is empty and gives both derivatives, with no text; a null URI is empty; repeated rows give
repeated records, and of two titles the first counts, so there are no ties to break; a row without an identifier gets one from its URI and payload; an empty table gives no rows; columns besides those named
are not read.
"""

import base64
import datetime
import hashlib
import html
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the RFC 4122 name space of URLs
DATE = "1970-01-01T00:00:00Z"

RESPONSE = "source_id long, record_id string, target_uri string, date string, http_headers string, payload string"
DERIVED = (
    "source_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, "
    "block_digest string, source_block_digest string, source_payload_digest string, source_status string, block string"
)

_BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_HIDDEN = frozenset(("script", "style", "noscript", "template"))
#: A tag without angle brackets in its quotes: a try ends at the next bracket, so all tries together are linear in the page.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)")
_CLOSE = re.compile(r"\s*>")
_EDGE = re.compile(r"""[>"']""")
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s'"]+))""", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
_BREAKS = re.compile(r" ?\n[ \n]*")


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


class _Page:
    """A cursor over a page. A search that fails once isn't made again, so that a broken page costs no more than a sound one."""

    def __init__(self, page: str):
        self.page = page
        self.none: set[str] = set()  # what doesn't occur any more
        self.quoted = True  # whether tags are still taken to end outside of quotes

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def tag(self, at: int) -> tuple[bool, str, str, int] | None:
        """Whether it is a closing tag, its name, what follows the name, and the place after it; None if no tag begins here."""
        if m := _TAG.match(self.page, at):
            return bool(m[1]), m[2].lower(), m[3], m.end()
        if not (m := _NAME.match(self.page, at)):
            return None
        end = self._outside(m.end()) if self.quoted else -1
        if end < 0:
            self.quoted = False
            end = self.find(">", m.end())
            if end < 0:
                return None
        return bool(m[1]), m[2].lower(), self.page[m.end() : end], end + 1

    def _outside(self, at: int) -> int:
        """The next > that is not in quotes."""
        while m := _EDGE.search(self.page, at):
            if m[0] == ">":
                return m.start()
            at = self.find(m[0], m.end()) + 1
            if not at:
                return -1
        return -1

    def closing(self, name: str, at: int) -> tuple[int, int]:
        """Begin and end of the next closing tag of this name; the end of the page if there is none."""
        size = len(self.page)
        while name not in self.none:
            begin = self.find("</", at)
            if begin < 0:
                break
            if self.page[begin + 2 : begin + 2 + len(name)].lower() == name and (end := _CLOSE.match(self.page, begin + 2 + len(name))):
                return begin, end.end()
            at = begin + 2
        self.none.add(name)
        return size, size


def plain_text(page: str) -> tuple[str, str, list[str]]:
    """The text, title and links of a page; blocks begin new lines, and what isn't shown is left out.

    A quote that is never closed makes tags end at the next > from there on; a < without any > is text.
    """
    page = page.replace("\n", " ")
    cursor, out, links, title, at = _Page(page), [], [], "", 0
    while (begin := page.find("<", at)) >= 0:
        out.append(page[at:begin])
        if page.startswith("<!--", begin):
            end = cursor.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), begin):
            end = cursor.find(">", begin)
            if end < 0:
                out.append("<")
            at = begin + 1 if end < 0 else end + 1
            continue
        tag = cursor.tag(begin)
        if tag is None:
            out.append("<")
            at = begin + 1
            continue
        ends, name, rest, at = tag
        if not ends and name in _HIDDEN:
            at = cursor.closing(name, at)[1]
        elif not ends and name == "title":
            stop, after = cursor.closing(name, at)
            title = title or _BLANKS.sub(" ", html.unescape(page[at:stop])).strip()
            at = after
        else:
            if name == "a" and not ends and (h := _HREF.search(rest)):
                links.append(html.unescape(next(x for x in h.groups() if x is not None)))
            if name in _BLOCKS:
                out.append("\n")
    out.append(page[at:])
    return _BREAKS.sub("\n", _BLANKS.sub(" ", html.unescape("".join(out)))).strip(), title, links


def identifier(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {name}')}>"


def derivatives(record_id: str, uri: str, date: str, headers: str, payload: str) -> list[tuple]:
    """The rows of DERIVED, but for source_id, of one response."""
    raw = payload.encode()
    own = digest(headers.encode() + raw), digest(raw)
    text, title, links = plain_text(payload)
    status = headers.partition("\r\n")[0]
    fields = [f"http-{x}" if k else f"http-status: {x}" for k, x in enumerate(headers.strip().split("\r\n")) if x]
    fields += [f"source-block-digest: {own[0]}", f"source-payload-digest: {own[1]}", f"title: {title}", *(f"outlink: {_BLANKS.sub(' ', x)}" for x in links)]
    out = []
    for kind, form, block in (("metadata", "application/warc-fields", "\r\n".join(fields) + "\r\n"), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode()
        out.append((kind, identifier(kind, record_id), record_id, uri, date, form, len(data), digest(data), *own, status, block))
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table of pages (page_id, url, html), as a crawler would have written them."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(text("html")).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("source_id"), F.lit(None).cast("string").alias("record_id"), text("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), text("html").alias("payload"))


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records (DERIVED) of response records (RESPONSE)."""
    names = [x.split()[0] for x in DERIVED.split(", ")]
    kind = pa.schema([(n, pa.int64() if n in ("source_id", "content_length") else pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = []
                for source, own, uri, date, head, page in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    uri, head, page = uri or "", head or "", page or ""
                    own = own or identifier("response", f"{source} {uri} {digest(page.encode())}")
                    rows += [(source, *x) for x in derivatives(own, uri, date or DATE, head, page)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return records.select(*[x.split()[0] for x in RESPONSE.split(", ")]).mapInArrow(run, DERIVED)


def serialised(records: DataFrame, made: str | None = None) -> DataFrame:
    """The records of derive() as WARC records, in a column warc, without the two line ends after a record. made: their WARC-Date, by default now."""
    made = made or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    lines = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "date"),
        ("WARC-Target-URI", "target_uri"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Block-Digest", "source_block_digest"), ("WARC-Source-Payload-Digest", "source_payload_digest"),
        ("WARC-Source-HTTP-Status", "source_status"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    head = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("\r\n")) for name, c in lines]
    return records.withColumn("warc", F.concat(F.lit(f"WARC/1.1\r\nWARC-Date: {made}\r\n"), *head, F.lit("\r\n"), F.col("block")))


def write_warc(records: DataFrame, path: str, made: str | None = None, compression: str = "gzip") -> None:
    """Writes the records of derive() as WARC files, one per partition, by Spark's text writer."""
    serialised(records, made).select("warc").write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _named(head: bytes) -> dict[str, str]:
    named = dict(x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in named.items()}


class _Records:
    """Puts the records of a file together from its chunks, which are what lies between two places that look like a record's begin."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.named: dict[str, str] = {}
        self.missing = 0

    def _begun(self, chunk: bytes) -> bool:
        head, gap, body = chunk.partition(b"\r\n\r\n")
        self.named = _named(head)
        size = self.named.get("content-length", "")
        # the last record's two line ends are still there
        self.parts, self.missing = [body], int(size) - len(body) if gap and size.isdigit() else 0
        return bool(gap) and size.isdigit()

    def add(self, chunk: bytes):
        """(named headers in lower case, block, whether it is whole) of the records that end here."""
        if self.missing > 0:
            # the separator was part of the block
            self.parts += [SEPARATOR, chunk]
            self.missing -= len(SEPARATOR) + len(chunk)
        elif not self._begun(chunk):
            return
        if self.missing <= 0:
            yield self.named, b"".join(self.parts)[: int(self.named["content-length"])], True

    def end(self):
        if self.missing > 0:
            yield self.named, b"".join(self.parts), False
        self.missing = 0


#: Stands before every record but a file's first one.
SEPARATOR = b"\r\n\r\nWARC/"


def read_responses(spark: SparkSession, path: str, damaged: str = "fail") -> DataFrame:
    """The response records (RESPONSE, without source_id) of WARC files, plain or gzipped, in as many members as they like.

    Spark's text source gives the chunks between records, decompressing as it reads, so a task holds one record and not a file; plain files are read in splits.
    A record that the file's end cuts off is left out. damaged: what a compressed file that can't be read to its end does, "fail" the job or "keep" the records before the damage.
    A plain file whose block holds a separator may lose that one record where a split begins just there.
    """
    if damaged not in ("fail", "keep"):
        raise ValueError("damaged must be fail or keep")
    names = [x.split()[0] for x in RESPONSE.split(", ")]
    kind = pa.schema([(n, pa.int64() if n == "source_id" else pa.string()) for n in names])

    def row(named, block):
        head, gap, body = block.partition(b"\r\n\r\n")
        return None, named.get("warc-record-id"), named.get("warc-target-uri", ""), named.get("warc-date", DATE), (head + gap).decode("utf-8", "replace"), body.decode("utf-8", "replace")

    def run(batches):
        at, records = None, _Records()
        for batch in batches:
            rows = []
            for file, split, chunk in zip(*(batch.column(k) for k in range(3)), strict=True):
                if (file, split) != at:
                    at, records = (file, split), _Records()
                rows += [row(named, block) for named, block, whole in records.add(chunk.as_py()) if whole and named.get("warc-type") == "response"]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(names), kind, strict=True)], schema=kind)

    reader = spark.read.option("lineSep", SEPARATOR.decode()).option("ignoreCorruptFiles", damaged == "keep")
    chunks = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("chunk"))
    return chunks.mapInArrow(run, RESPONSE)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = derive(responses(table(spark, sf_dir, "pages")))
    return found.select(F.col("source_id").alias("page_id"), *found.columns[1:], F.sha2("block", 256).alias("block_sha256"))
