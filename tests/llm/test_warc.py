import gzip
import hashlib
import random
import uuid

import pytest

from farebox.llm import warc


def pages():
    rng = random.Random(3)
    big = ["é" * 600, "x" * 1000, "y" * 5000 + "\r\n\r\nWARC/1.1\r\n\r\n"]
    rows = [(k, f"http://h/{k}\r\nX: y", rng.choice([*big, "short", "", None, "z" * 999, f"only {k} " * 300]), k) for k in range(60)]
    return rows + [(7, "u", rows[7][2], 1), (None, None, big[0], 2), (None, "n", "w" * 2000, 3), (None, "n", "w" * 2000, 4)]


def expected(rows):
    last = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            last[data] = max(last.get(data, i), i)
    out = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        to = last.get(data) if last.get(data) != i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to, data if to is None else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1, 3000, 1 << 20])
def test_round_trip(spark, part_bytes):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, payload int").repartition(3)
    parts = warc.write_parts(frame, "page_id", "url", "html", part_bytes)
    got = warc.read_archives(parts).collect()
    assert all(r.problem is None for r in got)
    keyed = [(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got]
    assert sorted(keyed, key=str) == expected(rows)
    assert {r.uri for r in got if r.record_id == 5} == {"http://h/5X: y"}
    assert warc.read_archives(warc.write_parts(frame.limit(0), "page_id", "url", "html")).count() == 0


def test_members_are_whole_gzip_files():
    data = [warc.record_bytes(k, f"u{k}", b"payload %d" % k, None) for k in range(3)]
    archive = b"".join(map(warc.member, data))
    assert gzip.decompress(archive) == b"".join(data)
    plain = gzip.compress(b"".join(data))
    assert [r["record_id"] for r in warc.read_records(plain)] == [0, 1, 2]


def test_broken_archives_keep_what_was_read():
    good = warc.member(warc.record_bytes(1, "u", b"abc" * 500, None))
    other = warc.record_bytes(2, "u", b"def" * 500, None)
    for bad in (warc.member(other)[:-20], warc.member(other.replace(b"def", b"deg", 1)), b"no gzip", warc.member(b"HTTP nonsense\r\n\r\n"), warc.member(other[:-2])):
        rows = list(warc.read_records(good + bad))
        assert [r.get("record_id") for r in rows] == [1, None] and rows[1]["problem"]
    assert list(warc.read_records(b"")) == []


def test_files_and_tables(spark, tmp_path):
    frame = spark.createDataFrame(pages(), "page_id long, url string, html string, payload int")
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write_archives(frame, path)
    assert warc.read_archives(spark.read.parquet(path), payload=False).where("problem IS NULL").count() == len(pages())
    (tmp_path / "a.warc.gz").write_bytes(warc.member(warc.record_bytes(9, "u", b"q", None)))
    files = spark.read.format("binaryFile").load(f"{tmp_path}/a.warc.gz")
    row = warc.read_archives(files, "path").first()
    assert (row.record_id, bytes(row.payload)) == (9, b"q")
