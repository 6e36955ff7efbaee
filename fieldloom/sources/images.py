"""Image files: PNG, TIFF, JPEG and BMP decoding to channel rows, 16-bit label PNGs. Files are read by Spark, JPEG and BMP
decoded by its image source, the others in Arrow batches.

Decoded: PNG of 8 or 16 bits (grey, RGB, palette, with or without alpha; not interlaced); TIFF of unsigned 8, 16 or 32 bits
or 32 or 64 bit floats, in strips or tiles, plain, deflated or LZW, with or without horizontal differences, chunky or
planar, one or more pages; JPEG and BMP of 8 bits. Anything else is an OSError that names the file; alpha is dropped."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples a pixel of the PNG colour types.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: struct letters of the TIFF field types that are read.
_FIELDS = {1: "B", 3: "H", 4: "I"}


def _unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of filter byte and data as plain rows."""
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1), np.uint8)
    for k, row in enumerate(raw):
        kind, line, above = row[0], row[1:], out[k]
        if kind == 0:
            out[k + 1] = line
        elif kind == 2:
            out[k + 1] = line + above
        elif kind == 1:
            for c in range(step):
                out[k + 1, c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            now, up = [0] * step + line.tolist(), [0] * step + above.tolist()
            for i in range(step, len(now)):
                a, b, c = now[i - step], up[i], up[i - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc_ = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc_ else b if pb <= pc_ else c
                now[i] = (now[i] + guess) & 255
            out[k + 1] = now[step:]
        else:
            raise OSError("unknown PNG filter")
    return out[1:]


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, bands) as uint8 or uint16, alpha dropped."""
    if data[:8] != _SIGNATURE:
        raise OSError("not a PNG")
    at, packed, palette, header = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if header is None:
        raise OSError("PNG without header")
    width, height, depth, colour, _, _, interlaced = header
    if depth not in (8, 16) or interlaced or colour not in _SAMPLES:
        raise OSError(f"PNG of {depth} bits, colour type {colour}, interlace {interlaced}")
    n = _SAMPLES[colour]
    step = n * depth // 8
    rows = _unfilter(np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * step), step)
    pixels = (rows.reshape(-1).view(">u2").astype(np.uint16) if depth == 16 else rows).reshape(height, width, n)
    if colour == 3:
        return palette[pixels[:, :, 0]]
    return pixels[:, :, : n - 1] if colour in (4, 6) else pixels


def encode_png(pixels: np.ndarray) -> bytes:
    """A grey PNG of an unsigned 8 or 16 bit array of two dimensions."""
    depth = 8 * pixels.dtype.itemsize
    rows = pixels.astype(f">u{depth // 8}").reshape(pixels.shape[0], -1).view(np.uint8).reshape(pixels.shape[0], -1)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()
    chunks = ((b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], depth, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw)), (b"IEND", b""))
    return _SIGNATURE + b"".join(struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body)) for kind, body in chunks)


def decode_tiff(data: bytes) -> np.ndarray:
    """All pages: (height, width), with a last axis for chunky and a first axis for planar bands or pages where there are any."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise OSError("not a TIFF")
    at, pages = struct.unpack(order + "I", data[4:8])[0], []
    while at:
        (n,) = struct.unpack(order + "H", data[at : at + 2])
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * k : at + 10 + 12 * k])
            if kind in _FIELDS:
                size = count * struct.calcsize(_FIELDS[kind])
                lo = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * k : at + 14 + 12 * k])[0]
                tags[tag] = struct.unpack(f"{order}{count}{_FIELDS[kind]}", data[lo : lo + size])
        (at,) = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])
        pages.append(_tiff_page(data, tags, order))
    return pages[0] if len(pages) == 1 else np.stack(pages)


def unpack_lzw(data: bytes) -> bytes:
    """A strip or tile of TIFF's LZW: codes of 9 to 12 bits, the highest first, that widen one code early."""
    single = [bytes([k]) for k in range(256)] + [b"", b""]  # 256 clears the table, 257 ends the data
    table, before, width, held, n, out = list(single), b"", 9, 0, 0, []
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < width:
            continue
        n -= width
        code, held = held >> n, held & (1 << n) - 1
        if code == 257:
            break
        if code == 256:
            table, before, width = list(single), b"", 9
            continue
        if code > len(table) - (not before):
            raise OSError("broken LZW data")
        entry = table[code] if code < len(table) else before + before[:1]
        if before:
            table.append(before + entry[:1])
        out.append(entry)
        before, width = entry, 9 + sum(len(table) >= k for k in (511, 1023, 2047))
    return b"".join(out)


def _tiff_page(data: bytes, tags: dict, order: str) -> np.ndarray:
    first = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, bits, packing = first(256, 0), first(257, 0), first(258, 1), first(259, 1)
    bands, kind, planar, differences, tiled = first(277, 1), first(339, 1), first(284, 1) == 2, first(317, 1), 324 in tags
    across, down = (first(322, 0), first(323, 0)) if tiled else (width, min(first(278, height), height))
    known = packing in (1, 5, 8, 32946) and (tiled or 273 in tags) and (kind, bits) in {(1, 8), (1, 16), (1, 32), (3, 32), (3, 64)}
    if not known or differences not in (1, 2) or (differences == 2 and kind == 3) or not across or not down:
        raise OSError(f"TIFF of {bits} bits, sample format {kind}, compression {packing}, predictor {differences}")
    unpack = {1: bytes, 5: unpack_lzw}.get(packing, zlib.decompress)
    values = np.dtype(f"{order}{'f' if kind == 3 else 'u'}{bits // 8}")
    planes, each = (bands, 1) if planar else (1, bands)
    out = np.zeros((planes, height, width, each), values.newbyteorder("="))
    columns = -(-width // across)
    for k, (lo, size) in enumerate(zip(*((tags[324], tags[325]) if tiled else (tags[273], tags[279])), strict=True)):
        plane, place = divmod(k, columns * -(-height // down))
        y, x = place // columns * down, place % columns * across
        rows = down if tiled else min(down, height - y)
        block = np.frombuffer(unpack(data[lo : lo + size]), values, count=rows * across * each).reshape(rows, across, each).astype(out.dtype)
        if differences == 2:
            block = np.cumsum(block, 1, dtype=block.dtype)
        out[plane, y : y + rows, x : x + across] = block[: height - y, : width - x]
    if bands == 1:
        return out[0, :, :, 0]
    return out[:, :, :, 0] if planar else out[0]


def _stands_out(pixels: np.ndarray) -> int | None:
    """The first band of the greatest variance, if the bands' variances differ much; one dye lights one band."""
    spread = pixels.reshape(-1, pixels.shape[2]).astype(np.float32).var(0)
    return int(spread.argmax()) if np.ptp(spread) > 0.15 * max(float(spread.max()), 1e-6) else None


def luminance(levels: np.ndarray) -> np.ndarray:
    """Of (height, width, 3) whole levels, in whole numbers: 0.299, 0.587 and 0.114 in parts of 2 ** 14, rounded."""
    r, g, b = np.moveaxis(levels.astype(np.int64), 2, 0)
    return (4899 * r + 9617 * g + 1868 * b + 8192) >> 14


def unit_range(pixels: np.ndarray) -> np.ndarray:
    """Single precision in [0, 1]: whole numbers by their type's range, others cut off."""
    if pixels.dtype.kind in "iu":
        return pixels.astype(np.float32) / np.float32(np.iinfo(pixels.dtype).max)
    return np.clip(pixels.astype(np.float32), 0, 1)


def one_channel(pixels: np.ndarray, mode: str | int = "auto") -> np.ndarray:
    """Whole levels (height, width, bands) as one channel of levels: the band that stands out, else luminance; gray: always
    luminance; a number: that band. One band stays as it is."""
    if pixels.shape[2] == 1:
        return pixels[:, :, 0]
    if mode not in ("auto", "gray"):
        return pixels[:, :, int(mode)]
    band = _stands_out(pixels) if mode == "auto" else None
    return luminance(pixels).astype(pixels.dtype) if band is None else pixels[:, :, band]


def shown_channel(pixels: np.ndarray) -> np.ndarray:
    """An uploaded picture as one channel in [0, 1]. Scaled before bands are joined, as means are no whole numbers any more;
    without a band that stands out three bands give their luminance, others their mean."""
    a = unit_range(pixels if pixels.ndim == 3 else pixels[:, :, None])
    a = a[:, :, :3] if a.shape[2] == 4 else a
    band = _stands_out(a) if a.shape[2] > 1 else 0
    if band is not None:
        return a[:, :, band]
    return a @ np.array([0.299, 0.587, 0.114], np.float32) if a.shape[2] == 3 else a.mean(2)


def channels_last(stack: np.ndarray) -> tuple[np.ndarray, str]:
    """A stack as (height, width, channels) and its layout. Of three axes the first holds channels if it has at most 8 and is
    shorter than both others; four axes are projected by the maximum over the first."""
    if stack.ndim == 4:
        stack, layout = channels_last(stack.max(0))
        return stack, f"projected {layout}"
    if stack.ndim == 2:
        return stack[:, :, None], "plane"
    if stack.ndim != 3:
        raise ValueError(f"a stack of {stack.ndim} axes")
    if stack.shape[0] <= 8 and stack.shape[0] < min(stack.shape[1:]):
        return np.moveaxis(stack, 0, 2), "channels first"
    return stack, "channels last"


_ROW = {"image_id": "string", "path": "string", "channel_idx": "int", "height": "int", "width": "int", "dtype": "string", "layout": "string", "data": "array<double>"}
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.float64())]


def _channel_rows(path: str, pixels: np.ndarray, layout: str) -> pa.RecordBatch:
    stem = os.path.splitext(os.path.basename(path))[0]
    h, w, n = pixels.shape
    rows = [(stem, path, k, h, w, str(pixels.dtype), layout, pixels[:, :, k].ravel().astype(float)) for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=list(_ROW))


def read_images(spark: SparkSession, folder: str, change=None) -> DataFrame:
    """image_id (file name without suffix), path, channel_idx, height, width, dtype, layout, data (array<double>, row by row)
    of every PNG, TIFF, JPEG and BMP file directly in a folder; one row a channel. A file that can't be read is an OSError.

    change: a function of (height, width, channels) pixels and layout that gives both anew, before channels are parted."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).where(F.lower("path").rlike(r"\.(tiff?|png)$"))
    pictures = spark.read.format("image").option("pathGlobFilter", "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[bB][mM][pP]}").load(folder).select("image.*")
    change = change or (lambda pixels, layout: (pixels, layout))

    def decode(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    data = content.as_py()
                    pixels, layout = (decode_png(data), "channels last") if path.lower().endswith("png") else channels_last(decode_tiff(data))
                except (OSError, ValueError, IndexError, KeyError, zlib.error, struct.error) as e:
                    raise OSError(f"cannot read {path}: {e}") from e
                yield _channel_rows(path, *change(pixels, layout))

    def unpack(batches):
        for batch in batches:
            for path, h, w, n, data in zip(*(batch.column(c).to_pylist() for c in ("origin", "height", "width", "nChannels", "data")), strict=True):
                if h <= 0:
                    raise OSError(f"cannot read {path}")
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                yield _channel_rows(path, *change(pixels if n == 1 else pixels[:, :, 2::-1], "channels last"))  # blue comes first

    schema = ", ".join(f"{k} {v}" for k, v in _ROW.items())
    return files.select("path", "content").mapInArrow(decode, schema).unionByName(pictures.drop("mode").mapInArrow(unpack, schema))


def load_images(spark: SparkSession, folder: str, channel_names: list[str] | None = None, nuclei: str | int | None = None, pixel_size_um: float | None = None) -> DataFrame:
    """read_images with data in [0, 1], and channel (its name), role and pixel_size_um.

    nuclei names the channel, or its number, that is segmented on. Without it and names, files of three channels become one:
    the band that stands out, else luminance on 8 bits; other files are segmented on their first channel. A name or number
    that a file lacks, or names that are not as many as its channels, are an error."""
    if isinstance(nuclei, str) and nuclei not in (channel_names or [nuclei]):
        raise ValueError(f"no channel {nuclei!r}; one of {', '.join(channel_names)}")
    join = nuclei is None and channel_names is None

    def change(pixels, layout):
        a = unit_range(pixels)
        names = channel_names or [f"ch{k}" for k in range(a.shape[2])]
        if len(names) != a.shape[2] or not (nuclei is None or nuclei in names or (isinstance(nuclei, int) and 0 <= nuclei < len(names))):
            raise ValueError(f"{a.shape[2]} channels, but names {names} and nuclei {nuclei!r}")
        if join and a.shape[2] == 3:
            band = _stands_out(a)
            one = luminance((np.clip(a, 0, 1) * 255).astype(np.uint8)).astype(np.float32) / np.float32(255) if band is None else a[:, :, band]
            return one[:, :, None], "luminance" if band is None else f"band {band}"
        return a, layout

    rows = read_images(spark, folder, change)
    k = F.col("channel_idx")
    single = F.col("layout").rlike("^(luminance|band [0-9]+)$")
    name = F.get(F.array(*map(F.lit, channel_names)), k) if channel_names else F.when(single, F.lit("nuclei")).otherwise(F.concat(F.lit("ch"), k))
    chosen = name == nuclei if isinstance(nuclei, str) else k == (nuclei or 0)
    return rows.withColumns({"channel": name, "role": F.when(chosen, F.lit("nuclei")), "pixel_size_um": F.lit(pixel_size_um).cast("double")})


def label_pngs(fields: DataFrame) -> DataFrame:
    """image_id and png (binary): labels as 16-bit grey PNG files; an id over 65535 is a ValueError."""

    def encode(batches):
        for batch in batches:
            h, w, made = batch.column("height").to_pylist(), batch.column("width").to_pylist(), []
            for k, v in enumerate(batch.column("labels")):
                ids = v.values.to_numpy(zero_copy_only=False)
                if ids.max(initial=0) > 65535:
                    raise ValueError("more than 65535 objects do not fit a 16-bit file")
                made.append(encode_png(ids.astype(np.uint16).reshape(h[k], w[k])))
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(made, pa.binary())], names=["image_id", "png"])

    kind = fields.schema["image_id"].dataType.simpleString()
    return fields.select("image_id", "height", "width", "labels").mapInArrow(encode, f"image_id {kind}, png binary")


def save_labels(fields: DataFrame, folder: str) -> None:
    """One file image_id.png a row of fields, in a folder that every executor mounts; a repeated write replaces the same file."""
    os.makedirs(folder, exist_ok=True)

    def write(rows):
        for r in rows:
            to = os.path.join(folder, f"{r['image_id']}.png")
            with open(f"{to}.{os.getpid()}", "wb") as f:
                f.write(r["png"])
            os.replace(f.name, to)

    label_pngs(fields).foreachPartition(write)
