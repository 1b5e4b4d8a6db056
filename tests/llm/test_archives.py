import struct
import zipfile
import zlib

import duckdb
import pytest

from phonoframe.llm import archives


def reader(raw):
    return lambda at, n: raw[at : at + n]


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_query(spark, sf_dir, monkeypatch, broadcast_rows):
    monkeypatch.setattr(archives, "BROADCAST_ROWS", broadcast_rows)
    got = sorted(map(tuple, archives.op5_zip_archives(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").where("page_id is not null").collect()), key=str)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT page_id, url, html FROM '{sf_dir}/pages.parquet/*.parquet' WHERE page_id IS NOT NULL")
    assert got == sorted(c.sql(archives.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_null_page_id(spark, sf_dir, monkeypatch, broadcast_rows):
    monkeypatch.setattr(archives, "BROADCAST_ROWS", broadcast_rows)
    pages = spark.createDataFrame([(None, "u", "y" * 200), (4, "u", "y" * 200), (4, "u", "y" * 200), (9, "u", "y" * 200)], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.refers_to or 0) for r in archives.with_revisits(pages).collect()) == [(0, 4), (4, 0), (4, 0), (9, 4)]
    r = archives.op5_zip_archives(spark, sf_dir).where("page_id is null").collect()
    assert [(x.payload_bytes, x.record_type, x.refers_to) for x in r] == [(200, "response", None)]


def test_package_is_a_zip_file_and_is_read_by_range(tmp_path):
    raw = archives.package([("1", b"first"), ("2", b"second record")])
    (tmp_path / "a.zip").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and z.read(archives.DATA) == b"firstsecond record"
    members = archives.directory(reader(raw), len(raw))
    at = archives.stored_at(reader(raw), members[archives.DATA])
    assert raw[at + 5 : at + 18] == b"second record"
    assert [p for p in archives.ranges(raw[archives.stored_at(reader(raw), members[archives.INDEX]) :][: members[archives.INDEX].size])] == [[(0, 5), (5, 13)]]


def zip64(name, body, comment=b""):
    local = struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, zlib.crc32(body), 2**32 - 1, 2**32 - 1, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    data = local + body
    central = struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, zlib.crc32(body), 2**32 - 1, 2**32 - 1, len(name), 28, 0, 0, 0, 0, 2**32 - 1) + name + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, 1, 1, len(central), len(data))
    locator = struct.pack("<IIQI", 0x07064B50, 0, len(data) + len(central), 1)
    return data + central + end64 + locator + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, len(comment)) + comment


def test_zip64_and_comments():
    raw = zip64(b"a/b", b"hello", b"a comment with PK\x05\x06 inside")
    m = archives.directory(reader(raw), len(raw))["a/b"]
    assert (m.size, m.packed, m.header, m.method) == (5, 5, 0, 0)
    at = archives.stored_at(reader(raw), m)
    assert raw[at : at + 5] == b"hello"


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        archives.directory(reader(b"no zip file"), 11)
    record = archives.warc_record(1, "u", b"payload", "0" * 64, None)
    with pytest.raises(ValueError):
        archives.parse_record(record)


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert archives.archived(none).count() == 0


def test_many_tasks_read_and_large_packages_are_shared(spark, tmp_path):
    pages = spark.range(400).selectExpr("id as page_id", "'u' as url", "cast(concat(repeat(cast(id as string), 60), 'x') as binary) as html").repartition(5)
    full = archives.with_revisits(pages)
    manifest = archives.write_packages(full, f"file://{tmp_path}/a", 4000)
    assert manifest.count() > 5
    assert archives.parts_of(manifest).rdd.getNumPartitions() == manifest.count()
    one = archives.write_packages(full.coalesce(1), f"file://{tmp_path}/b")
    assert one.count() == 1 and archives.parts_of(one, 1000).count() > 5
    for of in (manifest, one):
        assert sorted(r.page_id for r in archives.read_packages(of, f"file://{tmp_path}").collect()) == list(range(400))
