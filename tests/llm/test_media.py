import hashlib
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from factloom.llm import media as M
from factloom.llm.queries import op5_media_columns


@pytest.mark.parametrize("data", [b"", b"a", bytes(range(256)) * 3, b"x" * 192, b"y" * 193])
def test_png_is_lossless(data):
    image = M.encode_png(data)
    samples, n = M.decode_png(image)
    assert n == len(data) and samples.tobytes()[:n] == data and set(samples.tobytes()[n:]) <= {32} and samples.size % 192 == 0 and samples.size > 0
    assert image == M.encode_png(data) and M.feature(samples) == M.feature(samples.copy())


def test_damage_is_noticed():
    image = bytearray(M.encode_png(b"hello"))
    image[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        M.decode_png(bytes(image))


def test_query_digests(spark, small):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = op5_media_columns(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id]
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        image = M.encode_png(raw)
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())


def test_odd_rows(odd, empty):
    rows = M.media_features(odd).collect()
    assert len(rows) == odd.count() and sum(r.doc_id is None for r in rows) == 1
    assert {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {192}
    five = {tuple(r[1:]) for r in rows if r.doc_id == 5}
    assert len(five) == 1 and M.media_features(empty).count() == 0


def test_ranges_share_members_and_errors_stay_with_them(spark, odd, tmp_path):
    uri = f"file://{tmp_path}/a"
    n = M.write_archives(odd.coalesce(1), uri)
    spark.dataSource.register(M.MemberArchives)
    table = spark.read.format("member_archives").option("rangeBytes", 700).load(uri)
    assert table.rdd.getNumPartitions() > 3
    rows = table.collect()
    assert len(rows) == n and len({(r.archive, r.offset) for r in rows}) == n and not any(r.error for r in rows)
    tar = next((tmp_path / "a").glob("*.tar"))
    data = bytearray(tar.read_bytes())
    data[sorted(r.offset for r in rows)[1] + 148] ^= 1
    tar.write_bytes(bytes(data))
    bad = [r.error for r in spark.read.format("member_archives").option("tries", 1).load(uri).collect()]
    assert len(bad) == n and sum(e is not None for e in bad) == 1


def test_stray_files_of_failed_tasks_are_not_read(spark, odd, tmp_path):
    uri = f"file://{tmp_path}/b"
    n = M.write_archives(odd, uri)
    (tmp_path / "b" / "part-000099-1.tar").write_bytes(b"\0" * 2048)
    spark.dataSource.register(M.MemberArchives)
    assert spark.read.format("member_archives").load(uri).count() == n
    assert pafs.FileSystem.from_uri(uri) and np.all(True)
