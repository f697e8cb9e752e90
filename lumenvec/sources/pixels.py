"""Images: sizes, decoding, the model's input, patch features, and rendered patches.

PNG, BMP and binary PPM are decoded here; other formats need the imaging library, which is used where
it is installed. Everything runs on files' bytes inside Arrow functions, one image at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Mean and deviation of the channels that backbones are trained with (fixed values).
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
#: Patch feature sizes of the public backbones (fixed values).
MODEL_DIMS = {
    "dinov2_vits14": 384, "dinov2_vitb14": 768, "dinov2_vitl14": 1024, "dinov2_vitg14": 1536,
    "dinov2_vits14_reg": 384, "dinov2_vitb14_reg": 768, "dinov2_vitl14_reg": 1024, "dinov2_vitg14_reg": 1536,
}
#: Where a model's dictionary may keep its patch tokens, in order (fixed values).
TOKEN_KEYS = ("x_norm_patchtokens", "patch_tokens", "patchtokens")


def image_size(content: bytes) -> tuple[int, int]:
    """Width and height from a file's header; (-1, -1) if it has none that is known."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", content[16:24])
        if content[:2] == b"BM":
            w, h = struct.unpack("<ii", content[18:26])
            return w, abs(h)
        if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
            if content[12:16] == b"VP8X":
                return 1 + int.from_bytes(content[24:27], "little"), 1 + int.from_bytes(content[27:30], "little")
            if content[12:16] == b"VP8L":
                bits = int.from_bytes(content[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            w, h = struct.unpack("<HH", content[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if content[:2] == b"\xff\xd8":
            at = 2
            while True:
                marker, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                    return w, h
                at += 2 + size
    except (struct.error, IndexError):
        pass
    return -1, -1


def _unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """PNG scan lines without their filters."""
    lines = np.frombuffer(raw, np.uint8).reshape(rows, stride + 1)
    out, above = np.zeros((rows, stride), np.uint8), np.zeros(stride, np.uint8)
    for k in range(rows):
        kind, line = lines[k, 0], lines[k, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            for x in range(stride):
                a, b, c = (int(line[x - step]) if x >= step else 0), int(above[x]), (int(above[x - step]) if x >= step else 0)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (int(line[x]) + guess) & 255
        out[k] = above = line
    return out


def _png(content: bytes) -> np.ndarray:
    width, height = struct.unpack(">II", content[16:24])
    depth, colour, _, _, interlaced = content[24:29]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced:
        raise ValueError("only plain PNG of 8 bits is decoded here")
    data, palette, at = b"", None, 8
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        if kind == b"IDAT":
            data += content[at + 8 : at + 8 + size]
        elif kind == b"PLTE":
            palette = np.frombuffer(content[at + 8 : at + 8 + size], np.uint8).reshape(-1, 3)
        at += 12 + size
    x = _unfiltered(zlib.decompress(data), height, width * channels, channels).reshape(height, width, channels)
    if palette is not None:
        return palette[x[:, :, 0]]
    return x[:, :, :3] if channels >= 3 else np.repeat(x[:, :, :1], 3, axis=2)


def decode(content: bytes) -> np.ndarray:
    """Red, green and blue of a file's pixels, ``(height, width, 3)`` of bytes."""
    try:
        import PIL.Image as library
    except ImportError:
        library = None
    if library is not None:
        import io

        with library.open(io.BytesIO(content)) as image:
            return np.asarray(image.convert("RGB"))
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(content)
    if content[:2] == b"BM":
        start, (width, height), bits = int.from_bytes(content[10:14], "little"), struct.unpack("<ii", content[18:26]), int.from_bytes(content[28:30], "little")
        if bits != 24:
            raise ValueError("only BMP of 24 bits is decoded here")
        stride = (3 * width + 3) // 4 * 4
        x = np.frombuffer(content, np.uint8, abs(height) * stride, start).reshape(abs(height), stride)[:, : 3 * width].reshape(abs(height), width, 3)[:, :, ::-1]
        return x[::-1] if height > 0 else x
    if content[:2] == b"P6":
        _, width, height, most = content.split(maxsplit=4)[:4]
        if int(most) != 255:
            raise ValueError("only PPM of 8 bits is decoded here")
        return np.frombuffer(content[-3 * int(width) * int(height) :], np.uint8).reshape(int(height), int(width), 3)
    raise ValueError("no decoder for this image")


@lru_cache(maxsize=256)
def _bicubic(size: int, target: int) -> np.ndarray:
    """Weights ``(target, size)`` of cubic convolution (a = -1/2), widened when shrinking."""
    scale = size / target
    wide = max(scale, 1.0)
    at = np.abs((np.arange(size) + 0.5 - (np.arange(target)[:, None] + 0.5) * scale) / wide)
    w = np.where(at < 1, (1.5 * at - 2.5) * at * at + 1, np.where(at < 2, ((-0.5 * at + 2.5) * at - 4) * at + 2, 0))
    return w / w.sum(1, keepdims=True)


def resized(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bytes resized by cubic convolution, across and then down, rounded after each."""
    for axis, target in ((1, width), (0, height)):
        if x.shape[axis] != target:
            y = np.moveaxis(np.tensordot(_bicubic(x.shape[axis], target), x.astype(float), (1, axis)), 0, axis)
            x = np.clip(np.floor(y + 0.5), 0, 255).astype(np.uint8)
    return x


def model_input(content: bytes | None, size: int) -> tuple[np.ndarray, bool, str]:
    """``(3, size, size)`` of scaled and normalised channels, whether it went well, and the error; zeros if not."""
    try:
        x = resized(decode(content), size, size).astype(np.float32) / np.float32(255)
        return ((x - np.float32(CHANNEL_MEAN)) / np.float32(CHANNEL_STD)).transpose(2, 0, 1), True, ""
    except Exception as error:  # whatever a file holds, the batch keeps its shape
        return np.zeros((3, size, size), np.float32), False, repr(error)


def _lists(x: np.ndarray) -> pa.ListArray:
    width = x.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, width), dtype=np.int32)), pa.array(np.ascontiguousarray(x, np.float32).ravel()))


def image_tensors(images: DataFrame, size: int) -> DataFrame:
    """``path, image, ok, error`` of ``images (path, content)``: channel after channel, row after row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                x, ok, error = model_input(content.as_py(), size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()], pa.string()), _lists(x.reshape(1, -1)), pa.array([ok]), pa.array([error])], ["path", "image", "ok", "error"]
                )

    return images.select("path", "content").mapInArrow(run, "path string, image array<float>, ok boolean, error string")


def patch_tokens(output: object) -> np.ndarray:
    """The patch tokens ``(batch, patches, features)`` in what a model returns: a dictionary, a sequence or the array."""
    if isinstance(output, dict):
        key = next((k for k in TOKEN_KEYS if k in output), None)
        if key is None:
            raise KeyError(f"no patch tokens among {sorted(map(str, output))}")
        return np.asarray(output[key])
    if isinstance(output, list | tuple):
        for item in output:
            if getattr(item, "ndim", 0) == 3:
                return np.asarray(item)
    if getattr(output, "ndim", 0) == 3:
        return np.asarray(output)
    raise TypeError(f"no patch tokens in {type(output).__name__}")


def patch_features(images: DataFrame, model: Callable[[np.ndarray], object], size: int, patches: int, width: int, batch_images: int = 32) -> DataFrame:
    """``path, patch_index, vec, ok, error`` of ``images (path, content)``, by a model from ``(batch, 3, size, size)``.

    Images that can't be read go to the model as zeros, to keep the batch whole; their tokens are
    zeros too, with ``ok`` false and the error.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_images):
                part = batch.slice(at, batch_images)
                made = [model_input(c.as_py(), size) for c in part.column(1)]
                tokens = np.array(patch_tokens(model(np.stack([x for x, _, _ in made]))), np.float32)
                if tokens.shape != (len(made), patches, width):
                    raise ValueError(f"tokens of shape {tokens.shape}, not {(len(made), patches, width)}")
                ok = np.array([o for _, o, _ in made])
                tokens[~ok] = 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part.column(0).to_pylist(), patches), pa.string()), pa.array(np.tile(np.arange(patches, dtype=np.int32), len(made))),
                        _lists(tokens.reshape(-1, width)), pa.array(np.repeat(ok, patches)), pa.array([e for _, _, e in made for _ in range(patches)]),
                    ],
                    ["path", "patch_index", "vec", "ok", "error"],
                )

    return images.select("path", "content").mapInArrow(run, "path string, patch_index int, vec array<float>, ok boolean, error string")


def png(x: np.ndarray) -> bytes:
    """A PNG file of ``(height, width, 3)`` bytes."""
    height, width, _ = x.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((height, 1), np.uint8), np.ascontiguousarray(x, np.uint8).reshape(height, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def box(width: int, height: int, row: int, column: int, grid: tuple[int, int]) -> tuple[int, int, int, int]:
    """Pixel box of a patch, as ``functions.images.patch_box``."""
    x0, y0 = round(column * width / grid[1]), round(row * height / grid[0])
    return x0, y0, max(x0 + 1, round((column + 1) * width / grid[1])), max(y0 + 1, round((row + 1) * height / grid[0]))


def boxed(x: np.ndarray, row: int, column: int, grid: tuple[int, int], thick: int = 5) -> np.ndarray:
    """A red frame around a patch, growing outwards."""
    out, (height, width, _) = x.copy(), x.shape
    x0, y0, x1, y1 = box(width, height, row, column, grid)
    outer = np.zeros((height, width), bool)
    outer[max(0, y0 - thick + 1) : max(0, y1 + thick), max(0, x0 - thick + 1) : max(0, x1 + thick)] = True
    outer[y0 + 1 : y1, x0 + 1 : x1] = False
    out[outer] = (255, 0, 0)
    return out


def overlay(x: np.ndarray, value: np.ndarray, alpha: float) -> np.ndarray:
    """An image blended with the heat map of values in 0..1 on the grid of its patches."""
    v = 4 * np.clip(value, 0, 1)[:, :, None]
    heat = (np.clip(1.5 - np.abs(v - np.array([3.0, 2.0, 1.0])), 0, 1) * 255).astype(np.uint8)
    return (x * (1 - alpha) + resized(heat, *x.shape[:2]) * alpha).astype(np.uint8)


def in_square(x: np.ndarray, size: int) -> np.ndarray:
    """An image as large as fits a white square, in its middle."""
    scale = size / max(x.shape[:2])
    small = resized(x, *(max(1, round(n * scale)) for n in x.shape[:2]))
    out = np.full((size, size, 3), 255, np.uint8)
    top, left = ((size - n) // 2 for n in small.shape[:2])
    out[top : top + small.shape[0], left : left + small.shape[1]] = small
    return out


#: Height of the strip above a tile; its text is given beside the image, as no fonts are part of this library.
LABEL_HEIGHT = 24


def collage(tiles: list[np.ndarray], columns: int) -> np.ndarray:
    """Tiles in rows of so many columns, on white."""
    height, width = (max(t.shape[k] for t in tiles) for k in (0, 1))
    out = np.full((-(-len(tiles) // columns) * height, columns * width, 3), 255, np.uint8)
    for k, tile in enumerate(tiles):
        y, x = k // columns * height, k % columns * width
        out[y : y + tile.shape[0], x : x + tile.shape[1]] = tile
    return out


def rendered(rows: DataFrame, grid: tuple[int, int], tile: int = 224, alpha: float = 0.45) -> DataFrame:
    """``rows (content, patch_row, patch_col, values)`` with ``tile``, a PNG of the boxed image and the overlay side by side.

    ``values`` are the similarities of all patches of the image to the cluster. Rows whose image is
    null or can't be read are left out, as are those without values.
    """
    place = {c: rows.columns.index(c) for c in ("content", "patch_row", "patch_col", "values")}
    kept = [k for k, c in enumerate(rows.columns) if c not in ("content", "values")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                content, row, column, values = (batch.column(p)[k].as_py() for p in place.values())
                try:
                    x = decode(content)
                    sides = (boxed(x, row, column, grid), boxed(overlay(x, np.reshape(values, grid), alpha), row, column, grid, 4))
                except Exception:  # a missing or broken image is left out
                    continue
                strip = np.full((LABEL_HEIGHT, 2 * tile, 3), 255, np.uint8)
                out = np.concatenate([strip, np.concatenate([in_square(s, tile) for s in sides], axis=1)])
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in kept], pa.array([png(out)])], [*[batch.schema.names[c] for c in kept], "tile"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    fields = [rows.schema.fields[k] for k in kept]
    return rows.filter(F.col("content").isNotNull() & F.col("values").isNotNull()).mapInArrow(run, StructType([*fields, StructField("tile", BinaryType())]))


def scatter(panels: list[list[tuple[np.ndarray, tuple[int, int, int]]]], size: int = 480, radius: int = 2) -> np.ndarray:
    """Point sets ``(n, 2)`` with their colours, a panel beside the other."""
    shown = []
    for sets in panels:
        whole = np.concatenate([xy for xy, _ in sets])
        low, span = whole.min(0), np.maximum(whole.max(0) - whole.min(0), 1e-12)
        out = np.full((size, size, 3), 255, np.uint8)
        for xy, colour in sets:
            at = np.round((xy - low) / span * (size - 1 - 2 * radius)).astype(int) + radius
            for dx in range(-radius, radius + 1):
                for dy in range(-radius, radius + 1):
                    out[size - 1 - (at[:, 1] + dy), at[:, 0] + dx] = colour
        shown.append(out)
    return np.concatenate(shown, axis=1)


def write_collages(tiles: DataFrame, folder: str, columns: int) -> DataFrame:
    """A collage of each cluster's ``tiles (cluster_id, rank, tile)`` as PNG, in order of rank: ``cluster_id, tiles, path``.

    A group is the few rows that a top-k query left of a cluster.
    """
    from pathlib import Path

    def run(key: tuple, table: pa.Table) -> pa.Table:
        found = table.sort_by("rank")
        path = Path(folder) / f"cluster_{key[0].as_py():04d}_top{found.num_rows}_collage.png"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png(collage([decode(t) for t in found["tile"].to_pylist()], columns)))
        return pa.table({"cluster_id": pa.array([key[0].as_py()], pa.int32()), "tiles": pa.array([found.num_rows], pa.int32()), "path": [str(path)]})

    return tiles.select(F.col("cluster_id").cast("int"), "rank", "tile").groupBy("cluster_id").applyInArrow(run, "cluster_id int, tiles int, path string")
