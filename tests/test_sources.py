"""Image files, label files and synthetic fields."""

import struct
import zlib

import numpy as np
import pytest

from fieldloom.operators import kernels as K
from fieldloom.sources import images as I
from fieldloom.sources.synthetic import synthetic_field, synthetic_fields


def png(pixels, colour, filters):
    """A PNG file whose rows take the given filters in turn, built by the definition of each."""
    step = pixels.shape[2] * pixels.dtype.itemsize
    rows = pixels.astype(pixels.dtype.newbyteorder(">")).reshape(len(pixels), -1).view(np.uint8).reshape(len(pixels), -1).astype(int)
    raw, above = b"", np.zeros(rows.shape[1], int)
    for k, row in enumerate(rows):
        a, c = np.r_[np.zeros(step, int), row[:-step]], np.r_[np.zeros(step, int), above[:-step]]
        p = a + above - c
        far = np.stack([abs(p - a), abs(p - above), abs(p - c)])
        guess = [0 * row, a, above, (a + above) // 2, np.choose(far.argmin(0), [a, above, c])]
        f = filters[k % len(filters)]
        raw += bytes([f]) + ((row - guess[f]) % 256).astype(np.uint8).tobytes()
        above = row
    body = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8 * pixels.dtype.itemsize, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(b)) + k + b + b"\0\0\0\0" for k, b in ((b"IHDR", body), (b"IDAT", zlib.compress(raw)), (b"IEND", b"")))


def tiff(pages, order="<", packing=1):
    """A TIFF file of one strip a page."""
    out, link = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8)), 4
    for a in pages:
        strip = a.astype(a.dtype.newbyteorder(order)).tobytes()
        strip = zlib.compress(strip) if packing == 8 else strip
        at = len(out)
        out += strip
        struct.pack_into(order + "I", out, link, len(out))
        bands = a.shape[2] if a.ndim == 3 else 1
        tags = [(256, a.shape[1]), (257, a.shape[0]), (258, 8 * a.dtype.itemsize), (259, packing), (273, at), (277, bands), (279, len(strip)), (339, 3 if a.dtype.kind == "f" else 1)]
        out += struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHII", t, 4, 1, v) for t, v in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("bands, colour", [(1, 0), (3, 2), (2, 4), (4, 6)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_of_every_filter(bands, colour, kind):
    a = np.random.default_rng(bands).integers(0, np.iinfo(kind).max, (11, 9, bands)).astype(kind)
    got = I.decode_png(png(a, colour, [0, 1, 2, 3, 4, 4, 3]))
    assert got.dtype == kind and np.array_equal(got, a[:, :, : bands - (bands in (2, 4))])


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("packing", [1, 8])
def test_tiff_pages(order, packing):
    rng = np.random.default_rng(1)
    for a in (rng.random((6, 7)).astype("f4"), rng.integers(0, 60000, (6, 7, 3)).astype("u2")):
        assert np.array_equal(I.decode_tiff(tiff([a], order, packing)), a)
        assert np.array_equal(I.decode_tiff(tiff([a, a + 1], order, packing)), np.stack([a, a + 1]))


def lzw(data):
    """TIFF's LZW by its definition, with a clear code where the table is full."""
    table, width, held, bits = {bytes([k]): k for k in range(256)}, 9, 256, 9
    size, now = 258, b""
    for byte in data:
        if now + bytes([byte]) in table:
            now += bytes([byte])
            continue
        held, bits = held << width | table[now], bits + width
        table[now + bytes([byte])], size, now = size, size + 1, bytes([byte])
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        if size == 4094:
            held, bits = held << width | 256, bits + width
            table, width, size = {bytes([k]): k for k in range(256)}, 9, 258
    if now:
        held, bits = held << width | table[now], bits + width
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    held, bits = held << width | 257, bits + width
    return (held << -bits % 8).to_bytes((bits + 7) // 8, "big")


@pytest.mark.parametrize("size", [0, 1, 300, 5000, 40_000])
def test_lzw(size):
    rng = np.random.default_rng(size)
    for data in (rng.integers(0, 256, size, dtype=np.uint8).tobytes(), rng.integers(0, 3, size, dtype=np.uint8).tobytes(), b"a" * size):
        assert I.unpack_lzw(lzw(data)) == data
    with pytest.raises(OSError):
        I.unpack_lzw(b"\xff\xff\xff")


@pytest.mark.parametrize("tiled", [True, False])
@pytest.mark.parametrize("planar", [True, False])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_blocks(tiled, planar, predictor):
    a = np.random.default_rng(5).integers(0, 60000, (21, 19, 3)).astype("u2")
    across, down = (16, 16) if tiled else (19, 4)
    out, places, sizes = bytearray(struct.pack("<2sHI", b"II", 42, 0)), [], []
    for plane in ([a[:, :, k : k + 1] for k in range(3)] if planar else [a]):
        for y in range(0, 21, down):
            for x in range(0, 19, across):
                block = plane[y : y + down, x : x + across]
                if tiled:
                    block = np.pad(block, ((0, 16 - block.shape[0]), (0, 16 - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=block[:, :1] * 0)
                packed = lzw(block.astype("<u2").tobytes())
                places.append(len(out))
                sizes.append(len(packed))
                out += packed
    lists = []
    for values in (places, sizes):
        lists.append(len(out))
        out += struct.pack(f"<{len(values)}I", *values)
    struct.pack_into("<I", out, 4, len(out))
    tags = [(256, 1, 19), (257, 1, 21), (258, 1, 16), (259, 1, 5), (277, 1, 3), (284, 1, 2 if planar else 1), (317, 1, predictor), (339, 1, 1)]
    tags += [(322, 1, 16), (323, 1, 16), (324, len(places), lists[0]), (325, len(places), lists[1])] if tiled else [(278, 1, 4), (273, len(places), lists[0]), (279, len(places), lists[1])]
    out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, n, v) for t, n, v in tags) + b"\0\0\0\0"
    got = I.decode_tiff(bytes(out))
    assert np.array_equal(got, np.moveaxis(a, 2, 0) if planar else a)


def bmp(a):
    """24-bit BMP: blue first, the lowest row first, rows filled to four bytes."""
    rows = [r.tobytes() + b"\0" * (-r.size % 4) for r in a[::-1, :, ::-1]]
    body = b"".join(rows)
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, a.shape[1], a.shape[0], 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_bmp_and_jpeg(spark, tmp_path):
    a = np.random.default_rng(3).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    (tmp_path / "a.BMP").write_bytes(bmp(a))
    flat = spark._jvm.java.awt.image.BufferedImage(16, 8, 1)
    for y in range(8):
        for x in range(16):
            flat.setRGB(x, y, 0xC86432)
    assert spark._jvm.javax.imageio.ImageIO.write(flat, "jpg", spark._jvm.java.io.File(str(tmp_path / "b.jpg")))
    rows = {(r.image_id, r.channel_idx): r for r in I.read_images(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [(n, k) for n in "ab" for k in range(3)]
    assert all(rows["a", k].data == a[:, :, k].ravel().tolist() for k in range(3))
    for k, level in enumerate((0xC8, 0x64, 0x32)):
        assert (rows["b", k].height, rows["b", k].width) == (8, 16) and np.abs(np.array(rows["b", k].data) - level).max() <= 3
    (tmp_path / "c.jpeg").write_bytes(b"broken")
    with pytest.raises(Exception, match="cannot read"):
        I.read_images(spark, str(tmp_path)).collect()


def test_roles_and_one_channel(spark, tmp_path):
    rng = np.random.default_rng(4)
    dyed = np.stack([np.full((9, 8), 7), rng.integers(0, 256, (9, 8)), np.full((9, 8), 9)], 2).astype(np.uint8)
    grey = np.repeat(rng.integers(0, 256, (9, 8, 1)), 3, 2).astype(np.uint8)
    (tmp_path / "dyed.png").write_bytes(png(dyed, 2, [0]))
    (tmp_path / "grey.png").write_bytes(png(grey, 2, [0]))
    (tmp_path / "two.tif").write_bytes(tiff([dyed[:, :, 0], dyed[:, :, 1]]))
    rows = {(r.image_id, r.channel_idx): r for r in I.load_images(spark, str(tmp_path), pixel_size_um=0.5).collect()}
    assert sorted(rows) == [("dyed", 0), ("grey", 0), ("two", 0), ("two", 1)]
    assert [rows[k].role for k in sorted(rows)] == ["nuclei", "nuclei", "nuclei", None] and rows["two", 1].channel == "ch1" and rows["dyed", 0].pixel_size_um == 0.5
    assert np.allclose(rows["dyed", 0].data, dyed[:, :, 1].ravel() / 255) and rows["dyed", 0].layout == "band 1"
    assert np.abs(np.array(rows["grey", 0].data) - grey[:, :, 0].ravel() / 255).max() <= 1 / 255 + 1e-6 and rows["grey", 0].layout == "luminance"
    (tmp_path / "two.tif").unlink()
    named = I.load_images(spark, str(tmp_path), ["a", "b", "c"], "c").collect()
    assert len(named) == 6 and {(r.channel, r.role) for r in named} == {("a", None), ("b", None), ("c", "nuclei")}
    with pytest.raises(Exception, match="channels, but names"):
        I.load_images(spark, str(tmp_path), ["a", "b"]).collect()
    with pytest.raises(ValueError):
        I.load_images(spark, str(tmp_path), ["a", "b", "c"], "d")
    assert np.array_equal(I.one_channel(dyed), dyed[:, :, 1]) and np.array_equal(I.one_channel(dyed, 0), dyed[:, :, 0])
    assert np.array_equal(I.one_channel(grey), grey[:, :, 0]) and np.array_equal(I.one_channel(grey[:, :, :1]), grey[:, :, 0])
    assert np.array_equal(I.one_channel(dyed, "gray"), I.luminance(dyed))
    assert np.allclose(I.shown_channel(np.dstack([grey, grey[:, :, :1]])), grey[:, :, 0] / 255, atol=1e-6)
    assert np.allclose(I.shown_channel(grey[:, :, :2]), grey[:, :, 0] / 255) and np.allclose(I.shown_channel(grey[:, :, 0]), grey[:, :, 0] / 255)


def test_layouts():
    for shape, want, layout in (((64, 64), (64, 64, 1), "plane"), ((4, 64, 64), (64, 64, 4), "channels first"), ((64, 64, 3), (64, 64, 3), "channels last"), ((5, 1, 32, 32), (32, 32, 1), "projected channels first")):
        a, name = I.channels_last(np.zeros(shape))
        assert (a.shape, name) == (want, layout)
    with pytest.raises(ValueError):
        I.channels_last(np.zeros(4))


def test_folder_of_images_and_labels(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "a.PNG").write_bytes(I.encode_png(a))
    (tmp_path / "b.tif").write_bytes(tiff([a, a + 1, a + 2]))
    (tmp_path / "c.txt").write_text("no image")
    rows = {(r.image_id, r.channel_idx): r for r in I.read_images(spark, str(tmp_path)).collect()}
    assert rows["a", 0].data == a.ravel().tolist() and (rows["a", 0].height, rows["a", 0].width) == (3, 4)
    assert {k for k, _ in rows} == {"a", "b"}
    fields = spark.createDataFrame([(7, 2, 2, [0, 1, 65535, 2])], "image_id long, height int, width int, labels array<int>")
    I.save_labels(fields, str(tmp_path / "out"))
    assert I.decode_png((tmp_path / "out" / "7.png").read_bytes())[:, :, 0].tolist() == [[0, 1], [65535, 2]]
    with pytest.raises(Exception, match="65535 objects"):
        I.label_pngs(spark.createDataFrame([(7, 1, 1, [65536])], fields.schema)).collect()
    (tmp_path / "d.png").write_bytes(b"broken")
    with pytest.raises(Exception, match="cannot read"):
        I.read_images(spark, str(tmp_path)).collect()


def test_synthetic_fields(spark):
    image, labels = synthetic_field(n_objects=10, seed=2)
    assert image.dtype == np.float32 and 0 <= image.min() and image.max() <= 1
    assert labels.max() == 10 and K.label(labels > 0).max() == 10
    assert image[labels > 0].mean() > image[labels == 0].mean() + 0.2
    assert np.array_equal(image, synthetic_field(n_objects=10, seed=2)[0])
    rows = synthetic_fields(spark, 3, channels=2, side=64, n_objects=4).collect()
    assert len(rows) == 6 and {(r.channel_idx, r.role) for r in rows} == {(0, "nuclei"), (1, "marker")}
    assert len({tuple(r.labels) for r in rows if r.image_id == 1}) == 1


def test_non_local_means():
    flat = np.full((12, 12), 0.5)
    assert np.allclose(K.non_local_means(flat), flat)
    rng = np.random.default_rng(0)
    step = np.where(np.arange(24) < 12, 0.2, 0.8) * np.ones((24, 1))
    noisy = step + rng.normal(0, 0.02, step.shape)
    assert np.abs(K.non_local_means(noisy, 10.0) - step).mean() < 0.6 * np.abs(noisy - step).mean()


def test_convex_area():
    assert K.convex_area(*np.nonzero(np.ones((3, 5)))) == 15
    ell = np.ones((4, 4), bool)
    ell[:2, :2] = False
    assert ell.sum() < K.convex_area(*np.nonzero(ell)) <= 16
