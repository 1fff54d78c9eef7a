import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import media

from llm_data import ODD, documents


def test_store_texts_against_brute_force(spark):
    df = documents(spark, ODD)
    got = {r["doc_id"]: r for r in media.store_texts(df).collect()}
    assert len(got) == len(ODD)
    for i, text in enumerate(ODD):
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = media.text_as_image(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[3]["feature"] == got[9]["feature"]


def test_media_column_keeps_the_texts(spark):
    df = documents(spark, ["alpha", None, "beta"])
    images = media.texts_as_media(df)
    for r in images.collect():
        raw = media.decode(bytes(r["media"])).tobytes()
        assert raw.rstrip(b"\xff").decode() == (["alpha", "", "beta"][r["doc_id"]])
    odd = images.unionByName(spark.createDataFrame([(8, None), (9, b"junk")], "doc_id long, media binary"))
    got = {r["doc_id"]: r for r in media.media_features(odd, "doc_id", "media", 8).collect()}
    assert got[8]["tile"] is None and got[8]["error"] is None and got[9]["error"]
    assert media.read_npy(bytes(got[0]["tile"])).shape == (8, 8) and got[0]["width"] == 24
    assert media.store_texts(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.integers(0, 2**31))
def test_round_trips(h, w, colour, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if colour else (h, w), dtype=np.uint8)
    assert (media.decode(media.encode_netpbm(pixels)) == pixels).all()
    back = media.decode(media.encode_bmp(pixels))
    assert (back == pixels).all()
    assert (media.read_npy(media.npy_bytes(pixels)) == pixels).all()


def test_other_formats():
    assert media.decode(b"P1 # c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2\n2 1\n15\n0 15\n").tolist() == [[0, 255]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3\n").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\xff\xff").tolist() == [[255]]
    for bad in (b"", b"P9", b"P5\n9 9\n255\n1", b"BM" + b"\0" * 60):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_broken_images_are_value_errors(spark):
    good = media.encode_bmp(np.arange(6, dtype=np.uint8).reshape(2, 3))
    short = good[:46] + (2).to_bytes(4, "little") + good[50:]  # a palette of two colours, pixels beyond it
    masked = bytearray(media.encode_bmp(np.zeros((1, 1, 3), np.uint8)))
    masked[28:30], masked[30:34] = (32).to_bytes(2, "little"), (3).to_bytes(4, "little")
    bad = [short, good[:-5], b"P2\n1 1\n255\n99999999999999999999", b"P2\n1 1\n0\n0", b"P2\n1 1\n9\n10", b"P1\n2 1\n0 7", b"P4\n9 9\n\0", b"P5\n9999999 9999999\n255\n", b"P3\n1 1\n255\n1 x 2", bytes(masked)]
    for data in bad:
        with pytest.raises(ValueError):
            media.decode(data)
    df = spark.createDataFrame(list(enumerate([*bad, media.encode_netpbm(np.zeros((2, 2), np.uint8))])), "k long, m binary")
    rows = {r["k"]: r for r in media.media_features(df, "k", "m", 4).collect()}
    assert all(rows[i]["error"] and rows[i]["tile"] is None for i in range(len(bad))) and rows[len(bad)]["error"] is None


def test_masks_of_32_bit_images():
    pixels = np.array([[[1, 2, 3], [4, 5, 6]]], np.uint8)
    body = b"".join(bytes((0, r, g, b)) for r, g, b in pixels[0].tolist())
    ints = lambda size, *xs: b"".join(x.to_bytes(size, "little") for x in xs)
    data = b"BM" + ints(4, 66 + len(body), 0, 66) + ints(4, 40, 2, 1) + ints(2, 1, 32) + ints(4, 3, len(body), 0, 0, 0, 0) + ints(4, 0xFF00, 0xFF0000, 0xFF000000) + body
    assert (media.decode(data) == pixels).all()


def test_area_resize_against_means():
    pixels = np.arange(36, dtype=np.uint8).reshape(6, 6)
    assert np.allclose(media.area_resize(pixels, 3, 2), [[pixels[2 * i : 2 * i + 2, 3 * j : 3 * j + 3].mean() for j in range(2)] for i in range(3)])
    up = np.kron(pixels.astype(float), np.ones((4, 4)))  # 24 x 24, then means of whole cells
    assert np.allclose(media.area_resize(pixels, 8, 8), up.reshape(8, 3, 8, 3).mean(axis=(1, 3)))
    assert len(media.difference_hash(pixels)) == 16
