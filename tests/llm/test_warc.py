import gzip
import hashlib
import random

import pytest

from eatlas.llm import warc

from .helpers import collected

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def table(spark, rows):
    """Pages with columns that the operator uses inside."""
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id bigint, url string, html string, record string, part int, digest string")


def brute(rows, least):
    """(page_id, length, digest, type, refers_to) of every row; of rows with the largest page_id one is the response."""
    payloads = [(page, (html or "").encode()) for page, _, html in rows]
    order = sorted(range(len(rows)), key=lambda i: (payloads[i][0] is not None, payloads[i][0] or 0), reverse=True)
    keeper, out = {}, []
    for i in order:
        page, data = payloads[i]
        revisit = len(data) >= least and data in keeper
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper.get(data) if revisit else None))
        keeper.setdefault(data, page)
    return sorted(out, key=str)


def pages(seed):
    rng = random.Random(seed)
    pieces = ["<p>", "\r\n", "\r", "\n", "\r\r\n", "\r\n\r\n", "é", "漢字", "WARC/1.1", "0\r\n\r\n", " ", "\x00", "x" * 40, "\r\nContent-Length: 5\r\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 20, 200]))) for _ in range(40)]
    rows = [(i, f"http://h/{i}", rng.choice(texts)) for i in rng.sample(range(-100, 400), 90)]
    return rows + rows[:4] + [
        (900, None, None),
        (901, "http://a b\r\nX: y/\x7f", ""),
        (None, "http://n", rows[0][2]),
        (None, "http://n", "only without id " * 9),
        (None, "http://n", "only without id " * 9),
        (902, "u", "long " * 30000),
        (903, "u", "long " * 30000),
    ]


@pytest.mark.parametrize("chunk,least,files", [(7, 10, 400), (64, 30, 5000), (1 << 14, 1000, 32 << 20)])
def test_equal_to_brute_force(spark, chunk, least, files):
    rows = [r for r in pages(chunk) if chunk > 10 or r[0] not in (902, 903)]
    got = collected(warc.archive_digest(table(spark, rows).repartition(5), chunk, least, files), *COLUMNS)
    assert got == brute(rows, least)
    assert sum(r[3] == "revisit" for r in got) > 5


def test_chunks_of_payloads_come_back(spark, tmp_path):
    rows = pages(3)
    folder = str(tmp_path / "archives")
    warc.write_archives(table(spark, rows), folder, chunk=50, least=30)
    back = {}
    for r in warc.read_archives(spark, folder, chunk=33).orderBy("record_id", "part").collect():
        if r["record_type"] == "response":
            parts = back.setdefault(r["record_id"], (r["page_id"], []))[1]
            data = bytes(r["data"])
            assert r["part"] == len(parts) and (len(data) == 33 or r["last"])
            parts.append(data)
            whole = b"".join(parts)
            assert r["bytes"] == len(whole) and r["digest"] == hashlib.sha1(whole).hexdigest()
    got = sorted(((page, b"".join(parts)) for page, parts in back.values()), key=str)
    responses = [r for r in brute(rows, 30) if r[3] == "response"]
    assert sorted((str(p), len(d), hashlib.sha1(d).hexdigest()) for p, d in got) == sorted((str(r[0]), r[1], r[2]) for r in responses)


def test_archives_follow_the_format(spark, tmp_path):
    rows = [(1, "http://a", "é" * 30), (2, "http://b\r\nc d", "é" * 30), (3, None, None)]
    folder = tmp_path / "archives"
    warc.write_archives(table(spark, rows), str(folder), chunk=50, least=10)
    data = b"".join(gzip.decompress(f.read_bytes()) for f in folder.glob("*.gz"))
    records = {}
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        size = int(fields["Content-Length"])
        block, end, data = rest[:size], rest[size : size + 4], rest[size + 4 :]
        assert end == b"\r\n\r\n"
        records[int(fields["X-Page-ID"])] = fields, block
    one, two, three = (records[i] for i in (1, 2, 3))
    assert one[0]["WARC-Type"] == "revisit" and one[1] == b"" and one[0]["WARC-Refers-To"] == two[0]["WARC-Record-ID"]
    assert two[0]["WARC-Target-URI"] == "http://b%0D%0Ac%20d" and "WARC-Target-URI" not in three[0]
    text = ("é" * 30).encode()
    assert two[1].endswith(b"\r\n\r\n32\r\n" + text[:50] + b"\r\nA\r\n" + text[50:] + b"\r\n0\r\n\r\n")
    assert three[1].endswith(b"chunked\r\n\r\n0\r\n\r\n")
    assert two[0]["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(text).hexdigest()


def test_archives_of_others(spark, tmp_path):
    """Plain blocks, bodies that are not chunked, other records, a member of gzip for each record."""
    body = b"a\r\nb\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    blocks = [("warcinfo", b"text/plain", b"software: x\r\n"), ("response", b"application/http;msgtype=response", http), ("resource", b"text/html", body)]
    with open(tmp_path / "a.warc.gz", "wb") as f:
        for i, (kind, media, block) in enumerate(blocks):
            head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <r:%d>\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (kind.encode(), i, media, len(block))
            f.write(gzip.compress(head + block + b"\r\n\r\n"))
    got = collected(warc.read_archives(spark, str(tmp_path), payloads=False), "record_id", "record_type", "bytes", "digest")
    digest = hashlib.sha1(body).hexdigest()
    assert got[1:] == [("<r:1>", "response", 8, digest), ("<r:2>", "resource", 8, digest)]


def test_a_changed_payload_is_noticed(spark, tmp_path):
    folder = tmp_path / "archives"
    warc.write_archives(table(spark, [(1, "u", "some text")]), str(folder))
    for f in folder.glob("*.gz"):
        f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"some text", b"same text")))
        for crc in folder.glob(".*.crc"):
            crc.unlink()
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_archives(spark, str(folder)).collect()


def test_empty_table(spark):
    assert warc.archive_digest(table(spark, [])).count() == 0
