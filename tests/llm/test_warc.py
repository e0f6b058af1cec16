import gzip
import re
import time
from html.parser import HTMLParser

import pytest

from tidemark.llm import warc
from tidemark.llm._shared import table


class Reader(HTMLParser):
    """The text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.links = [], 0, [], []
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.in_title |= tag == "title"
        if tag == "a" and (h := dict(attrs).get("href")) is not None:
            self.links.append(h)
        if tag in warc._BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.in_title &= tag != "title"
        if tag in warc._BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.out.append(data.replace("\n", " "))


def brute(page):
    r = Reader()
    r.feed(page)
    r.close()
    lines = (re.sub(r"[ \t\r\f\v\xa0]+", " ", x).strip(" ") for x in "".join(r.out).split("\n"))
    return "\n".join(x for x in lines if x), " ".join("".join(r.title).split()), r.links


def test_text_of_the_pages(spark, sf_dir):
    pages = [r.html for r in table(spark, sf_dir, "pages").collect()]
    assert [warc.plain_text(p) for p in pages] == [brute(p) for p in pages]


def test_text_of_odd_markup():
    page = "<p title='a>b'>x &lt;b&gt; &#233;<!-- <p>no --><script>var t='</p>'</script>y<br>z<noscript>q</noscript></P><a HREF=k?a&amp;b>l</a> 1 < 2"
    assert warc.plain_text(page) == ("x <b> éy\nz\nl 1 < 2", "", ["k?a&b"])


def test_links_headers_and_digests(spark, sf_dir):
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    rows = warc.derive(warc.responses(table(spark, sf_dir, "pages"))).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    by_source = {}
    for r in rows:
        p = pages[r.source_id]
        assert r.target_uri == p.url and r.content_length == len(r.block.encode()) and r.block_digest == warc.digest(r.block.encode())
        assert r.source_payload_digest == warc.digest(p.html.encode())
        by_source.setdefault(r.refers_to, set()).add(r.record_type)
        if r.record_type == "metadata":
            assert f"http-Content-Length: {len(p.html.encode())}\r\n" in r.block and "http-status: HTTP/1.1 200 OK\r\n" in r.block
            assert f"source-payload-digest: {r.source_payload_digest}\r\n" in r.block
        else:
            assert r.block == brute(p.html)[0]
    assert all(kinds == {"metadata", "conversion"} for kinds in by_source.values())
    assert {r.record_id for r in rows} == {r.record_id for r in warc.op2(spark, sf_dir).collect()}


def record(kind, own, block):
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {own}\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


PAGE = "HTTP/1.0 404 No\r\nX-A: b\r\n\r\n<p>é &amp; WARC/1.1\r\n\r\nWARC/1.1 in a page".encode()


def test_files_are_read(spark, tmp_path):
    both = [record("warcinfo", "<i>", b"x"), record("response", "<r>", PAGE), record("response", "<e>", b"")]
    (tmp_path / "a.warc").write_bytes(b"".join(both))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, both)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(both)))
    (tmp_path / "d.warc").write_bytes(b"".join(both)[:-60])  # cut off in its last record
    (tmp_path / "e.warc").write_bytes(b"")
    found = warc.read_responses(spark, str(tmp_path)).collect()
    whole = ("<r>", "2020-01-02T03:04:05Z", "HTTP/1.0 404 No\r\nX-A: b\r\n\r\n", "<p>é &amp; WARC/1.1\r\n\r\nWARC/1.1 in a page")
    assert [(r.record_id, r.date, r.http_headers, r.payload) for r in found if r.record_id == "<r>"] == [whole] * 4
    assert sum(r.record_id == "<e>" for r in found) == 3 and len(found) == 7


def test_a_torn_file_keeps_what_is_before_the_damage(spark, tmp_path):
    data = gzip.compress(b"".join(record("response", f"<{i}>", PAGE + bytes(str(i), "ascii") * 50) for i in range(2000)), 1)
    (tmp_path / "a.warc.gz").write_bytes(data[: len(data) // 2])
    ids = [r.record_id for r in warc.read_responses(spark, str(tmp_path), damaged="keep").collect()]
    assert ids == [f"<{i}>" for i in range(len(ids))] and 500 < len(ids) < 2000
    with pytest.raises(Exception, match="(?s).*"):
        warc.read_responses(spark, str(tmp_path)).collect()


def test_files_are_written(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(record("response", "<r>", PAGE))
    derived = warc.derive(warc.read_responses(spark, str(tmp_path / "a.warc")))
    warc.write_warc(derived, str(tmp_path / "out"), made="2024-05-06T07:08:09Z")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "out").glob("*.gz"))
    read, records = [], warc._Records()
    for chunk in raw.split(warc.SEPARATOR):
        read += list(records.add(chunk))
    assert [h["warc-type"] for h, _, _ in read] == ["metadata", "conversion"]
    for h, block, _ in read:
        assert h["warc-refers-to"] == "<r>" and h["warc-refers-to-date"] == "2020-01-02T03:04:05Z" and h["warc-date"] == "2024-05-06T07:08:09Z"
        assert h["warc-source-payload-digest"] == warc.digest(PAGE.partition(b"\r\n\r\n")[2]) and h["warc-source-http-status"] == "HTTP/1.0 404 No"
        assert h["warc-block-digest"] == warc.digest(block)
    assert b"http-X-A: b\r\n" in read[0][1] and read[1][1].decode() == "é & WARC/1.1\r\n\r\nWARC/1.1 in a page".replace("\r\n\r\n", " ").replace("\r", "")


@pytest.mark.parametrize("piece", ["<title ", "<a ", '<a "', "<script ", "<script></script ", "<!--", "</", "<!", "<a '\">", "</script "])
def test_a_broken_page_takes_seconds(piece):
    began = time.process_time()
    warc.plain_text("<script>x</b>" + piece * (5_000_000 // len(piece)) if piece == "</script " else piece * (5_000_000 // len(piece)))
    assert time.process_time() - began < 15


def test_broken_markup_keeps_its_text():
    assert warc.plain_text("a <a href='x>b</a> c <i>d</i> <") == ("a b c d <", "", [])
    assert warc.plain_text("x <b title=\"1>2\">y</b> <title>t") == ("x y", "t", [])


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, record_id string, block string"
    rows = spark.createDataFrame([(1, None, None, "x", "y"), (None, "u", "<p>" * 50_000 + "end", None, None), (2, "u", "", "x", "y"), (2, "u", "", "x", "y")], schema)
    found = warc.derive(warc.responses(rows)).collect()
    assert len(found) == 8 and {r.block for r in found if r.record_type == "conversion"} == {"", "end"}
    assert warc.derive(warc.responses(spark.createDataFrame([], schema))).count() == 0
