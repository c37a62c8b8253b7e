import hashlib
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import common, media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=700))
def test_png_round_trip(data):
    samples, n = media.samples_of(media.png_of(data))
    assert n == len(data)
    payload = samples.tobytes()
    assert payload == data + b"\0" * ((-len(data) % 64) or (0 if data else 64))


def test_documents_read_back(spark, sf, texts):
    got = {r["doc_id"]: r for r in media.op1_media(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        data = t.encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        png = media.png_of(data)
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())


def test_edge_rows_and_empty(spark, edge, empty):
    path = common.new_folder(spark, "media")
    media.write_media(edge, path)
    got = media.features(media.read_media(spark, path)).collect()
    assert len(got) == edge.count()
    assert sum(r["key"] is None for r in got) == 1
    assert sum(r["n_bytes"] == 0 for r in got) == 2
    path = common.new_folder(spark, "media")
    media.write_media(empty, path)
    assert media.read_media(spark, path).count() == 0


def test_a_folder_of_several_writes(spark, documents):
    path = common.new_folder(spark, "media")
    for name in ("a", "b/c"):
        media.write_media(documents.limit(15), f"{path}/{name}")
    media.write_media(documents.limit(7), f"{path}/a")
    fs, folder = common.filesystem(path)
    fs.create_dir(f"{folder}/loose")
    for name, key in (("a/stray", "x"), ("loose/one", "y")):  # not of a commit; of a folder without commits
        with fs.open_output_stream(f"{folder}/{name}.zip") as out, zipfile.ZipFile(out, "w") as z:
            z.writestr(f"{key}.png", media.png_of(b"abc"))
    got = [r["key"] for r in media.read_media(spark, path).collect()]
    assert len(got) == 15 + 15 + 7 + 1 and "y" in got and "x" not in got


def test_ranges_partition_the_members(spark, documents):
    path = common.new_folder(spark, "media")
    media.write_media(documents, path)
    whole = media.read_media(spark, path)
    split = media.read_media(spark, path, splitbytes=3000)
    assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
    assert sorted(map(tuple, split.select("archive", "offset").collect())) == sorted(map(tuple, whole.select("archive", "offset").collect()))


def test_a_damaged_member_fails_alone(spark, documents):
    path = common.new_folder(spark, "media")
    media.write_media(documents.limit(20), path)
    fs, folder = common.filesystem(path)
    reader = media.ArchiveReader({"path": path})
    archive, _ = reader.archives()[0]
    info = zipfile.ZipFile(archive).infolist()[1]
    with open(archive, "r+b") as f:
        f.seek(info.header_offset + 60)
        f.write(b"\xff\xff\xff")
    bad = media.read_media(spark, path, mode="permissive", attempts=2).collect()
    assert len(bad) == 20 and [r["offset"] for r in bad if r["error"]] == [info.header_offset]
    with pytest.raises(Exception, match="checksum|offset"):
        media.read_media(spark, path, attempts=1).collect()


def test_a_member_is_tried_again(monkeypatch, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("1.png", media.png_of(b"abc"))
    failures = iter([True, False])
    read = media.read_member

    def flaky(handle, info):
        if next(failures):
            raise OSError("gone")
        return read(handle, info)

    monkeypatch.setattr(media, "read_member", flaky)
    reader = media.ArchiveReader({"path": f"file://{tmp_path}"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["error"] for r in rows] == [None] and media.samples_of(rows[0]["media"])[1] == 3


def test_feature_depends_on_samples_alone():
    a = np.arange(128, dtype=np.uint8).reshape(2, 64)
    assert media.feature_of(a) == media.feature_of(a.copy()) != media.feature_of(a[::-1].copy() // 2)
