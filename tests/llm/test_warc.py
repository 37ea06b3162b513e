"""Round trips of archives, ranges of files, and magics inside members."""

import zlib

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import warc


@pytest.fixture
def pages(spark):
    def build(rows):
        return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, payload string")

    return build


def by_hand(rows, least=0):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        first = min(ids) if ids and len(body) >= least else None
        revisit = first is not None and (i is None or i > first)
        out.append((i, len(body), warc.base32_digest(body), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)



def digests(records):
    number = warc.page_number
    return sorted(map(tuple, records.select(
        number(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to"))).collect()), key=repr)


ROWS = [(i, f"http://h/{i}\n x", f"<p>page {i % 7} é</p>" * (i % 5)) for i in range(60)] + [
    (100, None, None), (101, "u", ""), (None, "u", "<p>page"), (None, "u", "alone"), (5, "again", "<p>page 5 é</p>"), (5, "again", "<p>page 5 é</p>")]


@pytest.mark.parametrize("least", [0, 30])
def test_round_trip(spark, pages, tmp_path, least):
    warc.write(pages(ROWS).repartition(3), f"{tmp_path}/w", least)
    records = warc.read(spark, f"{tmp_path}/w")
    assert digests(records) == by_hand(ROWS, least)
    assert records.where("not intact").count() == 0
    bodies = {(r.record_id, bytes(r.payload)) for r in records.where("record_type = 'response'").collect()}
    assert ("urn:page:17", (ROWS[17][2]).encode()) in bodies or ROWS[17][2] in [r[2] for r in ROWS[:17]]


def test_files_are_plain_gzip_members(spark, pages, tmp_path):
    warc.write(pages(ROWS).coalesce(1), f"{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    whole = b""
    while data:
        inflate = zlib.decompressobj(31)
        whole += inflate.decompress(data)
        assert inflate.eof
        data = inflate.unused_data
    assert whole.count(b"WARC/1.1\r\n") == len(ROWS)


@pytest.mark.parametrize("size", ["97b", "1k", "100k"])
def test_ranges_and_false_magics(spark, tmp_path, chance, size):
    """Stored members show their payload's bytes as they are: magics in them are no members."""
    members, want = [], []
    for i in range(80):
        junk = bytes(chance.randrange(256) for _ in range(chance.randint(0, 400)))
        body = warc.MAGIC.join([junk, b"\x00\x00\x00\x00\x00\x00\x03", b"x" * chance.randint(0, 50)] * chance.randint(1, 3))
        head = (f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha1:{warc.base32_digest(body)}\r\n"
                f"Content-Length: {len(body)}\r\n\r\n").encode()
        squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)
        members.append(squeeze.compress(head + body + b"\r\n\r\n") + squeeze.flush())
        want.append((f"urn:page:{i}", body))
    (tmp_path / "f.warc.gz.bin").write_bytes(b"".join(members))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in before:
            spark.conf.set(key, size)
        got = [(r.record_id, bytes(r.payload)) for r in warc.read(spark, str(tmp_path)).where("intact").collect()]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sorted(got) == sorted(want)


def test_empty_table(spark, pages, tmp_path):
    warc.write(pages([]), f"{tmp_path}/w")
    assert warc.read(spark, f"{tmp_path}/w").count() == 0
