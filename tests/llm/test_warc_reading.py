"""WARC files of many members, repeated and folded headers, and text against an independent HTML parser."""

import gzip
import html.parser
import time

from linkloom.llm import warc


def response(i, block, *extra):
    return warc.record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:{i}>"), ("WARC-Target-URI", f"http://x/{i}"), *extra], block)


def test_members_take_time_in_proportion():
    """40,000 members: reading them one after the other must not copy the rest of the file for each."""
    one = gzip.compress(response(1, b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 8), mtime=0)
    took = []
    for n in (4_000, 40_000):
        data, start = one * n, time.process_time()
        assert sum(len(block) for _, block in warc.read_records(data)) == n * (2048 + 19)
        took.append(time.process_time() - start)
    assert took[1] < 30 * took[0] + 1


def test_records_over_several_steps(monkeypatch):
    """Records and headers cut anywhere by the steps of unpacking, plain and zipped, as one member and as many."""
    records = [response(i, b"HTTP/1.1 200 OK\r\n\r\n" + bytes([i]) * (i * 700)) for i in range(30)]
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + bytes([i]) * (i * 700) for i in range(30)]
    for step in (7, 100, 1 << 16):
        monkeypatch.setattr(warc, "STEP", step)
        for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
            assert [b for _, b in warc.read_records(data)] == blocks
    cut = b"".join(map(gzip.compress, records))[:-20]
    assert [b for _, b in warc.read_records(cut)][:29] == blocks[:29]
    damaged = gzip.compress(records[1]) + b"\x1f\x8bnonsense" + gzip.compress(records[2])
    assert [b for _, b in warc.read_records(damaged)] == [blocks[1]]
    assert list(warc.read_records(b"")) == [] and list(warc.read_records(b"WARC/1.0\r\nno end")) == []


def test_repeated_and_folded_headers(spark, tmp_path):
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:9>\r\nWARC-Protocol: h2\r\nWARC-Protocol: tls/1.3\r\nX-Note: one\r\n  two\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi"
    (tmp_path / "a.warc").write_bytes(f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    found = warc.derivatives(warc.responses_from_warc(spark, str(tmp_path))).collect()
    ((_, fields),) = warc.read_records(bytes(found[0]["metadata_record"]))
    lines = fields.decode().split("\r\n")
    assert [x for x in lines if "warc-protocol" in x] == ["source-header: warc-protocol: h2", "source-header: warc-protocol: tls/1.3"]
    assert "source-header: x-note: one two" in lines


def test_self_closing_elements():
    assert warc.extract("<svg/>after svg<p>more")[1] == "after svg\nmore"
    assert warc.extract("<svg width='1'><text>in</text></svg>out")[1] == "out"
    assert warc.extract("a<script src='x'/>b")[1] == "a"  # a slash does not close a script


class Plain(html.parser.HTMLParser):
    """Text and links by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.silent = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in warc.RAW:
            self.silent += 1
        if tag in warc.BREAKS:
            self.parts.append("\n")
        href = dict(reversed(attrs)).get("href")
        if tag == "a" and href is not None:
            self.links.append(href)

    def handle_startendtag(self, tag, attrs):
        if tag in warc.BREAKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in warc.RAW:
            self.silent = max(0, self.silent - 1)
        if tag in warc.BREAKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def test_text_and_links_of_all_pages(spark, data):
    for row in spark.read.parquet(f"{data}/pages.parquet").collect():
        page = row["html"] or ""
        other = Plain()
        other.feed(page)
        other.close()
        _, text, links = warc.extract(page)
        lines = (" ".join(line.split()) for line in "".join(other.parts).split("\n"))
        assert text == "\n".join(line for line in lines if line) and links == other.links
