import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from graphloom.llm import jpeg, media

# A small baseline encoder's tables, for images with AC terms and subsampling.
DC = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], bytes(range(12)))
AC_SYMBOLS = bytes([0x00, 0xF0, 0x01, 0x11, 0x02, 0x21, 0x03, 0x31, 0x04, 0x12])
AC = ([0, 0, 2, 4, 4, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], AC_SYMBOLS)


def bits_of(value, size):
    return format(value if value >= 0 else value + (1 << size) - 1, f"0{size}b") if size else ""


def codes(table):
    return {s: format(c, f"0{n}b") for c, n, s in jpeg._codes(*table)}


def tiny_jpeg(dcs, layout, width, height, restart=0, quant=16, ac=True, seed=0, fill=b""):
    """A baseline image whose blocks have the given DC terms, and some AC terms."""
    rng = np.random.default_rng(seed)
    dc_code, ac_code = codes(DC), codes(AC)
    text, last, chunks, units = "", {}, [], 0
    blocks = iter(dcs)
    per_unit = [c for c, h, v in layout for _ in range(h * v)]
    total = len(dcs) // len(per_unit)
    for unit in range(total):
        for c in per_unit:
            value = next(blocks)
            diff = value - last.get(c, 0)
            last[c] = value
            size = abs(diff).bit_length()
            text += dc_code[size] + bits_of(diff, size)
            if ac and rng.random() < 0.6:
                if rng.random() < 0.3:
                    text += ac_code[0xF0]
                for _ in range(rng.integers(1, 4)):
                    symbol = int(AC_SYMBOLS[rng.integers(2, 10)])
                    text += ac_code[symbol] + bits_of(1, 1).rjust(symbol & 15, "0")
            text += ac_code[0x00]
        units += 1
        if (restart and units % restart == 0) or unit == total - 1:
            text += "1" * (-len(text) % 8)
            raw = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
            chunks.append(raw)
            text, last = "", {}
    body = chunks[0] + b"".join(bytes([0xFF, 0xD0 + i % 8]) + c for i, c in enumerate(chunks[1:]))
    parts = b"".join(bytes([c + 1, h * 16 + v, 0]) for c, h, v in layout)
    frame = struct.pack(">BHHB", 8, height, width, len(layout)) + parts
    scan = bytes([len(layout)]) + b"".join(bytes([c + 1, 0]) for c, _, _ in layout) + bytes([0, 63, 0])
    table = lambda kind, t: bytes([kind, *t[0]]) + t[1]
    out = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0" + fill) + jpeg._segment(0xDB, bytes([0, *[quant] * 64])) + jpeg._segment(0xC0, frame)
    out += jpeg._segment(0xC4, table(0x00, DC) + table(0x10, AC))
    if restart:
        out += jpeg._segment(0xDD, struct.pack(">H", restart))
    return out + jpeg._segment(0xDA, scan) + body + b"\xff\xd9"


def grey(dcs, quant):
    return np.clip(np.floor_divide(np.asarray(dcs) * quant + 4, 8) + 128, 0, 255)


@pytest.mark.parametrize("restart", [0, 1, 5])
@pytest.mark.parametrize("ac", [False, True])
def test_grey_image_with_ac_terms(restart, ac):
    rng = np.random.default_rng(restart)
    dcs = rng.integers(-60, 60, 5 * 7).tolist()
    data = tiny_jpeg(dcs, [(0, 1, 1)], 50, 36, restart, ac=ac, fill=b"\xff\xd8\xff\xd9")
    image, thumb = jpeg.thumbnails([(data, 0)])[0]
    assert (image.width, image.height) == (50, 36) and thumb.shape == (5, 7)
    assert (thumb == grey(dcs, 16).reshape(5, 7)).all()


@pytest.mark.parametrize(("h", "v"), [(1, 1), (2, 1), (2, 2)])
def test_colour_image_takes_luminance_in_place(h, v):
    rng = np.random.default_rng(h + v)
    across, down = 3, 2
    width, height = across * h * 8 - 3, down * v * 8 - 3
    luma = rng.integers(-50, 50, (down * v, across * h))
    dcs = []
    for y in range(down):
        for x in range(across):
            dcs += luma[y * v : (y + 1) * v, x * h : (x + 1) * h].ravel().tolist()
            dcs += rng.integers(-50, 50, 2).tolist()
    data = tiny_jpeg(dcs, [(0, h, v), (1, 1, 1), (2, 1, 1)], width, height, 2)
    image, thumb = jpeg.thumbnails([(data, 0)])[0]
    assert len(image.parts) == 3 and (thumb == grey(luma, 16)[: -(-height // 8), : -(-width // 8)]).all()


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000])
def test_stored_form_round_trip(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    stored = jpeg.encode([media.padded(data)])[0]
    image, thumb = jpeg.thumbnails([(stored, 0)])[0]
    assert thumb.tobytes() == media.padded(data) and image.width == jpeg.ROW * 8 and jpeg.images_of(stored) == [0]


def test_very_long_payload_takes_several_images(monkeypatch):
    monkeypatch.setattr(jpeg, "MAX_ROWS", 3)
    payloads = [bytes(range(192)) * 8, b"\xff" * 192, b"\x00\xff" * 96 * 3]
    stored = jpeg.encode(payloads)
    assert len(jpeg.images_of(stored[0])) == 3
    rows = media.describe(stored)
    assert [r[5] for r in rows] == [hashlib.sha256(p).hexdigest() for p in payloads] and [r[2] for r in rows] == [3, 1, 1]


def test_broken_streams_give_errors_and_spare_others():
    good = jpeg.encode([media.padded(b"good text")])[0]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    cut = good[:-40]
    noise = tiny_jpeg([1] * 8, [(0, 1, 1)], 64, 8)
    noise = noise[:-8] + b"\x7f" * 6 + b"\xff\xd9"
    rows = media.describe([good, b"", None, b"not a jpeg", progressive, cut, noise[:200], good])
    assert [r[-1] is None for r in rows] == [True, False, False, False, False, False, False, True]
    assert rows[0] == rows[-1] and rows[2][8] is None and rows[3][8] == 10


def test_media_query(spark):
    docs = [(1, None), (2, ""), (3, "short"), (4, "é\U0001f600" * 300), (5, "long " * 60000), (5, "short"), (None, "x" * 192)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    stored = media.store(df)
    assert stored.columns == ["doc_id", "text", "n_bytes", "media"]
    for r in media.features(stored).collect():
        want = media.padded((r.text or "").encode())
        assert r.error is None and r.thumb_bytes == len(want) and r.thumb_sha256 == hashlib.sha256(want).hexdigest()
        assert r.thumb_tail_crc32 == zlib.crc32(want[-16:]) and r.n_bytes == len((r.text or "").encode())
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest() and r.media_bytes == len(r.media)
    assert media.features(media.store(df.limit(0))).count() == 0
    clash = df.withColumn("width", df.doc_id)
    assert media.features(media.store(clash), keep=["width"]).count() == len(docs)


def test_media_columns_with_any_names(spark):
    df = spark.createDataFrame([(1, None, "a", b"b"), (1, None, "a", b"b"), (2, "", "c", None)], "m long, t string, media_sha256 string, error binary")
    stored = media.store(df, "t", name="k0")
    out = media.features(stored, "k0", keep=["m", "t", "media_sha256", "error"])
    assert out.columns[:4] == df.columns and sorted(map(str, (r[:4] for r in out.collect()))) == sorted(map(str, (tuple(r) for r in df.collect())))
    assert len({tuple(r[4:]) for r in out.collect()}) == 1  # null and empty are stored alike


def test_average_hash():
    assert jpeg.average_hash(np.zeros((1, 1), np.uint8)) == "0" * 16
    half = np.zeros((16, 16), np.uint8)
    half[:, 8:] = 200
    assert jpeg.average_hash(half) == "0f" * 8


def test_a_short_segment_is_an_error():
    good = jpeg.encode([bytes(192)])[0]
    short = good.replace(b"\xff\xdd\x00\x04\x00\xc0", b"\xff\xdd\x00\x02")
    assert short != good
    results = media.describe([good, short, good])
    assert results[0] == results[2] and results[0][-1] is None and results[1][-1] == "short restart interval"


@pytest.mark.parametrize("seed", range(4))
def test_damaged_streams_never_raise_and_spare_others(seed):
    rng = random.Random(seed)
    colour = tiny_jpeg([rng.randrange(-40, 40) for _ in range(24)], [(0, 2, 2), (1, 1, 1), (2, 1, 1)], 32, 32, restart=1)
    whole = [jpeg.encode([rng.randbytes(192 * 2)])[0], colour]
    want = media.describe([whole[0]])[0]
    batch = []
    for _ in range(400):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randrange(1, 4)):
            at, what = rng.randrange(min(len(data), rng.choice([40, 400, 10000]))), rng.randrange(4)
            if what == 0:
                data[at] = rng.randrange(256)
            elif what == 1:
                data[at] ^= 1 << rng.randrange(8)
            elif what == 2:
                del data[at : at + rng.randrange(1, 20)]
            else:
                data[at:at] = rng.choice([b"\xff", b"\xff\xd0", b"\xff\xd9", b"\xff\xd8", rng.randbytes(3)])
            if len(data) < 2:
                break
        batch += [bytes(data[: rng.randrange(len(data) + 1)]) if rng.random() < 0.3 else bytes(data), whole[0]]
    found = media.describe(batch)
    assert all(r == want for r in found[1::2])
    assert all((r[-1] is None) == (r[0] is not None) for r in found) and any(r[-1] for r in found)
