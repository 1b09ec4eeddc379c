import zlib
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest

from loomwork.llm import media
from tests.llm.data import SCHEMA, documents


def brute_sums(x, oh, ow):
    h, w = x.shape
    out = [[Fraction(0)] * ow for _ in range(oh)]
    for i in range(oh):
        for j in range(ow):
            for y in range(h):
                for c in range(w):
                    a = max(0, min(Fraction((i + 1) * h, oh), y + 1) - max(Fraction(i * h, oh), y))
                    b = max(0, min(Fraction((j + 1) * w, ow), c + 1) - max(Fraction(j * w, ow), c))
                    out[i][j] += a * b * int(x[y, c])
    return [[int(v * oh * ow) for v in r] for r in out]


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (24, 24), (2, 40), (31, 7)])
@pytest.mark.parametrize("strip", [2, 4096])
def test_area_sums_are_exact(monkeypatch, shape, strip):
    monkeypatch.setattr(media, "STRIP", strip)
    x = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    for size in ((8, 9), (1, 1), (5, 3)):
        assert media.area_sums(x, *size).tolist() == brute_sums(x, *size)


def test_formats_round_trip():
    x = np.random.default_rng(2).integers(0, 256, (7, 13), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(x)) == x).all() and (media.decode(media.encode_bmp(x)) == x).all()
    assert (media.from_npy(media.npy(x)) == x).all()
    assert media.decode(b"P2 # note\n2 1\n15\n0 15").tolist() == [[0, 255]]
    assert media.decode(b"P6\n1 2\n255\nabcdef").tolist() == [[[97, 98, 99]], [[100, 101, 102]]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + np.array([40, 1, 2], "<i4").tobytes() + np.array([1, 24], "<u2").tobytes() + bytes(24)
    assert media.decode(head + b"\x01\x02\x03\x00\x04\x05\x06\x00").tolist() == [[[6, 5, 4]], [[3, 2, 1]]]


@pytest.mark.parametrize("bad", [None, b"", b"xx", b"P5", b"P5\n2 2\n255\nab", b"P5 0 1 255 ", b"P2 1 1 255 x", b"P2 1 1 255 " + b"9" * 40, b"P5 " + b"9" * 5000 + b" 1 255 ", b"P1 2 1 1", b"P1 1 1 7", b"P4 9 1\n\0", b"P5 1 1 65536 a", b"BM", b"BM" + bytes(60)])
def test_bad_bytes_are_errors(bad):
    with pytest.raises(ValueError):
        media.decode(bad)


def bmp(w, h, bits, rows, palette=b"", masks=b""):
    start = 54 + len(masks) + len(palette)
    head = b"BM" + bytes(8) + start.to_bytes(4, "little") + np.array([40, w, h], "<i4").tobytes() + np.array([1, bits], "<u2").tobytes()
    return head + np.array([3 if masks else 0, 0, 0, 0, 0, 0], "<i4").tobytes() + masks + palette + rows


def test_other_depths():
    assert media.decode(b"P1 3 2\n# note\n1 0 1\n001").tolist() == [[0, 255, 0], [255, 255, 0]]
    assert media.decode(b"P4 9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    assert media.decode(b"P5 2 1 65535\n\xff\xff\x80\x00").tolist() == [[255, 32768 * 255 // 65535]]
    assert media.decode(b"P2 2 1 1000 1000 500").tolist() == [[255, 127]]
    grey = lambda n: b"".join(bytes([v, v, v, 0]) for v in n)
    assert media.decode(bmp(3, 1, 1, b"\xa0\0\0\0", grey([7, 9]))).tolist() == [[9, 7, 9]]
    assert media.decode(bmp(3, 1, 4, b"\x12\x30\0\0", grey(range(16)))).tolist() == [[1, 2, 3]]
    assert media.decode(bmp(1, 1, 16, b"\x1f\x7c\0\0")).tolist() == [[[255, 0, 255]]]
    masks = np.array([0xF800, 0x7E0, 0x1F], "<u4").tobytes()
    assert media.decode(bmp(1, 1, 16, b"\xe0\x07\0\0", masks=masks)).tolist() == [[[0, 255, 0]]]


def test_clashing_columns_and_bad_samples_keep_the_row(spark):
    rows = spark.createDataFrame([(1, b"P2 1 1 255 " + b"9" * 40, 5, "x", b"y")], "id long, media binary, WIDTH int, error string, npy binary")
    got = media.features(rows)
    assert [c.lower() for c in got.columns].count("width") == 1 and got.columns[:2] == ["id", "npy"]
    assert got.first().error == "sample out of range" and got.select("width").first().width is None
    assert media.tiles(rows).columns == ["id", "WIDTH", "error", "tile_row", "tile_col", "npy", "dhash"] and media.tiles(rows).count() == 0


def test_difference_hash_is_brute_force():
    x = np.random.default_rng(3).integers(0, 256, (48, 24), dtype=np.uint8)
    sums = brute_sums(x, 8, 9)
    bits = "".join("1" if sums[r][c] > sums[r][c + 1] else "0" for r in range(8) for c in range(8))
    assert media.difference_hash(x) == f"{int(bits, 2):016x}"
    assert media.difference_hash(np.full((5, 5), 9, np.uint8)) == "0" * 16


def test_texts_come_back_whole(spark):
    docs = documents(spark)
    got = media.features(media.store_text(docs, keep=["doc_id"])).collect()
    want = []
    for r in docs.collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        want.append((r.doc_id, len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.dhash, bytes(r.tile))) == (r.media_sha256, r.dhash, bytes(r.tile))


def test_tiles_hold_every_pixel(spark):
    docs = documents(spark, [(1, "x" * 3000, "s"), (2, None, "s")])
    stored = media.store_text(docs)
    assert stored.columns == [*(c for c in docs.columns if c != "text"), "n_bytes", "media"]
    rows = sorted(media.tiles(stored, keep=["doc_id"]).where("doc_id = 1").collect(), key=lambda r: r.tile_row)
    whole = np.concatenate([media.from_npy(bytes(r.npy)) for r in rows])
    assert whole.tobytes() == b"x" * 3000 + b"\xff" * (3456 - 3000) and media.tiles(stored).count() == len(rows) + 1
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "id long, media binary")
    assert media.features(bad).where("error is not null and dhash is null").count() == 2 and media.tiles(bad).count() == 0


def test_empty_table(spark):
    assert media.features(media.store_text(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_matches_the_texts(spark):
    from loomwork.llm.queries import op2_media

    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        data = (r.text or "").encode()
        payload = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        want[r.doc_id] = (len(data), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), sha256(stored).hexdigest())
    rows = op2_media(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in rows} == want
    assert all(len(r.feature) == 16 for r in rows)
