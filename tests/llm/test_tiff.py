"""TIFF files against plain Python and round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from cases import some_text

from siltstone.llm import tiff


@pytest.mark.parametrize("pack,unpack", [(tiff.pack_bits, tiff.unpack_bits), (tiff.pack_lzw, tiff.unpack_lzw)])
def test_codecs_round_trip(pack, unpack):
    rng = random.Random(4)
    for data in (b"", b"a", b"a" * 1000, rng.randbytes(5000), b"abcab" * 4000):
        assert unpack(pack(data), len(data)) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("kind", ["u1", "u2"])
def test_tiff_pages_round_trip(spark, order, kind):
    """One row a page: strips and tiles, every compression, both predictors, both byte orders, 8 and 16 bits."""
    rng = np.random.default_rng(9)
    images = [rng.integers(0, 4 if i % 2 else 250, (h, w, c)).astype(kind) for i, (h, w, c) in enumerate([(1, 1, 1), (33, 70, 3), (300, 5, 1), (64, 64, 4)])]
    coding = [(c, p) for c in (tiff.NONE, tiff.LZW, tiff.PACKBITS, tiff.DEFLATE) for p in (1, 2)]
    files = [(i, tiff.write_pages(images, c, p, rows=20, tile=t, order=order)) for i, (c, p, t) in enumerate([(c, p, t) for c, p in coding for t in (None, 16)])]
    got = tiff.pages(spark.createDataFrame(files, "id int, file binary"), "file", ("id",)).collect()
    assert len(got) == len(files) * len(images) and all(r["error"] is None for r in got)
    for r in got:
        a = images[r["page"]]
        assert (r["height"], r["width"], r["samples"], r["bits"]) == (*a.shape, a.itemsize * 8)
        assert bytes(r["pixels"]) == a.astype(a.dtype.newbyteorder(order)).tobytes()


def test_broken_tiff_files_give_a_row_with_the_error(spark):
    good = tiff.write_pages([np.zeros((40, 40, 3), "u1")], tiff.DEFLATE, 2, tile=16)
    files: list[bytes | None] = [None, b"", b"II", b"no file at all", good[:-30], good[:60]]
    for tag, value in ((tiff.TILE_WIDTH, 0), (tiff.TILE_HEIGHT, 0), (tiff.WIDTH, 2**31), (tiff.HEIGHT, 2**31), (tiff.SAMPLES, 0), (tiff.COMPRESSION, 77), (tiff.BITS, 3)):
        at = good.index(struct.pack("<H", tag), struct.unpack_from("<I", good, 4)[0])
        files.append(good[: at + 4] + struct.pack("<II", 1, value) + good[at + 12 :])
    at = good.index(struct.pack("<H", tiff.TILE_WIDTH), struct.unpack_from("<I", good, 4)[0])
    files.append(good[: at + 4] + struct.pack("<I", 0) + good[at + 8 :])  # a field without values
    rng = random.Random(3)
    for _ in range(60):
        b = bytearray(good)
        for _ in range(3):
            b[rng.randrange(len(b))] = rng.randrange(256)
        files.append(bytes(b))
    got = tiff.pages(spark.createDataFrame(list(enumerate(files)), "id int, file binary"), "file", ("id",)).collect()
    assert {r["id"] for r in got} == set(range(1, len(files)))
    assert all(r["error"] and r["pixels"] is None for r in got if 0 < r["id"] <= 13)


def test_tiff_payload_read_back(spark, docs):
    """Every column from plain Python; pages() reads the stored files alike."""
    texts = [None, "", "x" * 191, "x" * 192, "é" * 400, "x" * 191, "ab\n" * 3000, some_text(random.Random(2), 400_000)]
    rows = tiff.text_features(docs(texts), keep_media=True).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    seen = {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(padded[-16:])
        media = bytes(r["media"])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        a = np.frombuffer(padded, "u1").astype(float)
        share = np.unique(a, return_counts=True)[1] / len(a)
        said = dict(x.split("=") for x in r["feature"].split(";"))
        assert int(said["height"]) * 192 == len(padded) and float(said["mean"]) == pytest.approx(a.mean(), abs=1e-3)
        assert float(said["spread"]) == pytest.approx(a.std(), abs=1e-3) and float(said["entropy"]) == pytest.approx(-(share * np.log2(share)).sum(), abs=1e-3)
        assert seen.setdefault(texts[r["doc_id"]] or "", r["feature"]) == r["feature"]
        read = sorted(tiff.pages(spark.createDataFrame([(bytearray(media),)], "m binary"), "m", ()).collect(), key=lambda p: p["page"])
        assert b"".join(bytes(p["pixels"]) for p in read) == padded and len(read) == int(said["pages"])
    assert tiff.text_features(docs([])).count() == 0
