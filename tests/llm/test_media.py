import hashlib
import math
import zipfile
import zlib
from pathlib import Path

import pytest

from gaugeworks.llm import media as M
from gaugeworks.llm.cluster import filesystem

from .samples import awkward, frame


def test_images_are_lossless():
    for raw in (b"", b"x", bytes(range(256)) * 3, b"a" * 192):
        payload = M.padded(raw)
        assert len(payload) % 192 == 0 and payload and payload[: len(raw)] == raw
        assert M.from_image(M.as_image(payload, len(raw))) == (payload, len(raw))
    with pytest.raises(ValueError):
        image = bytearray(M.as_image(M.padded(b"hello"), 5))
        image[-20] ^= 1
        M.from_image(bytes(image))


def test_columns_of_every_row(spark, monkeypatch):
    monkeypatch.setattr(M, "ARCHIVE_BYTES", 4000)
    rows = awkward()
    _, folder = M.write_archives(frame(spark, rows).repartition(2))
    got = M.media_features(M.read_archives(spark, folder, range_bytes=700)).collect()
    assert len(got) == len(rows)
    want = sorted((str(k), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) for k, t in rows for raw in [(t or "").encode()] for p in [M.padded(raw)])
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    by_payload = {}
    for r in got:
        by_payload.setdefault((r.payload_sha256, r.n_bytes), set()).add((r.media_sha256, r.feature, r.media_bytes))
    assert all(len(v) == 1 for v in by_payload.values())


def test_a_damaged_member_is_a_row_with_its_error(spark, monkeypatch):
    monkeypatch.setattr(M, "TRIES", 2)
    _, folder = M.write_archives(frame(spark, [(1, "one" * 100), (2, "two" * 100)]).coalesce(1))
    where, path = filesystem(folder)
    (name,) = map(str, Path(path).glob("*.zip"))
    data = bytearray(open(name, "rb").read())
    with zipfile.ZipFile(name) as z:
        at = z.infolist()[0].header_offset + 60
    data[at] ^= 255
    open(name, "wb").write(bytes(data))
    got = {r.doc_id: r for r in M.media_features(M.read_archives(spark, folder)).collect()}
    assert got[1].error and got[1].payload_sha256 is None and got[2].error is None and got[2].n_bytes == 300


def test_lost_storage_fails_the_task_and_a_short_gap_does_not(spark, monkeypatch):
    monkeypatch.setattr(M.time, "sleep", lambda s: None)
    _, folder = M.write_archives(frame(spark, [(1, "one" * 100)]).coalesce(1))
    reader, real, calls = M.ArchiveReader({"path": folder}), M.member_bytes, []

    def failing(times):
        def read(f, m):
            calls.append(m)
            if len(calls) <= times:
                raise OSError("storage is away")
            return real(f, m)

        calls.clear()
        monkeypatch.setattr(M, "member_bytes", read)
        return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    assert [(r["error"], r["media"] is None) for r in failing(M.TRIES - 1)] == [(None, False)]
    with pytest.raises(OSError):
        failing(M.TRIES)


def test_empty(spark):
    assert M.media_columns(frame(spark, [])).count() == 0


def test_only_archives_of_the_manifest_count(spark):
    """What a lost attempt of a task leaves behind is not read, and keys keep their type."""
    docs = spark.createDataFrame([("a/1", "one", 5), (None, "two", 6), ("ü x", None, 7)], "doc_id string, text string, n_bytes int")
    manifest, folder = M.write_archives(docs)
    where, path = filesystem(folder)
    for archive in list(Path(path).glob("*.zip")):
        (archive.parent / f"{archive.stem}-lost.zip").write_bytes(archive.read_bytes())
    assert M.read_archives(spark, folder).count() == 6
    got = M.media_features(M.read_archives(spark, folder, manifest=manifest), kind="string").collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == [("None", 3), ("a/1", 3), ("ü x", 0)]
    assert dict(M.media_columns(docs).dtypes)["doc_id"] == "string"


def test_a_damaged_image_keeps_its_row(spark):
    """Checksums of the archive are right, the image inside is not: one row is null."""
    good = M.as_image(b"x" * 192, 5)
    flipped = bytearray(good)
    flipped[-20] ^= 1
    short = plain_image(b"", 0)
    rows = [("00000000/k1.png", good, None), ("00000001/k2.png", bytes(flipped), None), ("00000002/k3.png", good[:30], None), ("00000003/k4.png", short, None), ("00000004/k5.png", None, "checksum differs"), ("00000005/k6.png", b"", None)]
    got = {r.doc_id: r for r in M.media_features(spark.createDataFrame(rows, "name string, media binary, error string")).collect()}
    assert got[1].n_bytes == 5 and got[1].error is None
    assert all(got[k].payload_sha256 is None and got[k].feature is None and got[k].error for k in (2, 3, 4, 5, 6))


def plain_feature(payload):
    mean = sum(payload) / len(payload)
    std = math.sqrt(sum((b - mean) ** 2 for b in payload) / len(payload))
    share = [payload.count(b) / len(payload) for b in set(payload)]
    bits = ""
    for k in range(64):
        part = payload[k * len(payload) // 64 : (k + 1) * len(payload) // 64]
        bits += "1" if sum(part) / len(part) > mean else "0"
    return mean, std, -sum(s * math.log2(s) for s in share), f"{int(bits, 2):016x}"


def plain_image(payload, n_bytes):
    """The stored form, chunk by chunk."""
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    head = (192).to_bytes(4, "big") + (len(payload) // 192).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    rows = b"".join(b"\0" + payload[i : i + 192] for i in range(0, len(payload), 192))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"n_bytes\0" + str(n_bytes).encode()) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def test_stored_form_and_feature_recomputed(spark):
    rows = [(k, t) for k, t in awkward(n=12) if k is not None and k != 3]
    got = {r.doc_id: r for r in M.media_columns(frame(spark, rows)).collect()}
    for key, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        image = plain_image(payload, len(raw))
        assert got[key].media_sha256 == hashlib.sha256(image).hexdigest() and got[key].media_bytes == len(image)
        mean, std, entropy, bits = plain_feature(payload)
        found = dict(p.split("=") for p in got[key].feature.split(";"))
        assert [float(found[k]) for k in ("mean", "std", "entropy")] == pytest.approx([mean, std, entropy], abs=6e-5) and found["hash"] == bits
