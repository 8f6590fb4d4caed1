"""Files of images: PNG and JPEG bytes, palette, debug and profile JSON, and one file per image written by the executors."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(rgba: np.ndarray) -> bytes:
    """A PNG of height x width x 4 bytes, rows unfiltered."""
    h, w, _ = rgba.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def _code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code of the symbols that occur, 16 bits at most, with room for a code of ones, which JPEG forbids.

    Counts below a thousandth of all are taken as that, which bounds the depth to 15; the symbol that stands for the ones is the lightest, one deeper at most."""
    used = np.flatnonzero(counts).tolist()
    heap = [(float(max(counts[i], counts.sum() / 1000)), i, [i]) for i in used] + [(0.0, len(counts), [len(counts)])]
    heapq.heapify(heap)
    out = np.zeros(len(counts) + 1, np.int64)
    while len(heap) > 1:
        (x, i, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        out[a + b] += 1
        heapq.heappush(heap, (x + y, i, a + b))
    return out


def _huffman(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Codes and lengths by symbol, and the table as JPEG tells it: how many codes of each length, then the symbols by length."""
    lengths = _code_lengths(np.bincount(symbols, minlength=256))
    order = sorted(np.flatnonzero(lengths).tolist(), key=lambda i: (lengths[i], i))
    codes, code, last = np.zeros(257, np.int64), 0, 0
    for i in order:
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    order = [i for i in order if i < 256]
    told = [sum(lengths[i] == n for i in order) for n in range(1, 17)]
    return codes, lengths, bytes(told) + bytes(order)


def encode_jpeg(rgb: np.ndarray, step: int = 1) -> bytes:
    """A baseline JPEG of height x width x 3 bytes, no chroma left out; a coefficient of frequency u, v is told in steps of 1 + step * (u + v)."""
    h, w, _ = rgb.shape
    px = np.pad(rgb.astype(float), ((0, -h % 8), (0, -w % 8), (0, 0)), "edge")
    y = px @ [0.299, 0.587, 0.114]
    planes = np.stack([y - 128, (px[..., 2] - y) / 1.772, (px[..., 0] - y) / 1.402])
    blocks = planes.reshape(3, len(y) // 8, 8, -1, 8).transpose(1, 3, 0, 2, 4).reshape(-1, 8, 8)
    k = np.arange(8)
    dct = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) / 2
    dct[0] /= np.sqrt(2)
    steps = 1 + step * (k[:, None] + k[None])
    zigzag = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
    coef = np.rint(dct @ blocks @ dct.T / steps).astype(np.int64).reshape(-1, 64)[:, zigzag]
    n, ones = len(coef), np.ones
    dc = coef[:, 0].reshape(-1, 3)
    dc = np.diff(dc, axis=0, prepend=np.zeros((1, 3), np.int64)).ravel()
    own, at = np.nonzero(coef[:, 1:])
    at += 1
    value = coef[own, at]
    gap = at - np.where(np.diff(own, prepend=-1) > 0, 0, np.concatenate([[0], at[:-1]])) - 1
    far = np.repeat(np.arange(len(at)), gap // 16)  # sixteen zeros each
    open_ = np.flatnonzero(coef[:, 63] == 0)
    bits = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
    low = lambda v: np.where(v < 0, v + (1 << bits(v)) - 1, v)
    # symbols in order of block and place: the first coefficient, runs of zeros, values, the end of the block
    place = np.concatenate([np.arange(n) * 256, own[far] * 256 + 2 * at[far], own * 256 + 2 * at + 1, open_ * 256 + 255])
    symbol = np.concatenate([bits(dc), 0xF0 * ones(len(far), int), gap % 16 << 4 | bits(value), 0 * open_])
    extra = np.concatenate([low(dc), 0 * far, low(value), 0 * open_])
    more = np.concatenate([bits(dc), 0 * far, bits(value), 0 * open_])
    tables = [_huffman(symbol[:n]), _huffman(symbol[n:])]
    code = np.concatenate([t[0][x] for t, x in zip(tables, (symbol[:n], symbol[n:]), strict=True)]) << more | extra
    size = np.concatenate([t[1][x] for t, x in zip(tables, (symbol[:n], symbol[n:]), strict=True)]) + more
    order = np.argsort(place, kind="stable")
    code, size = code[order], size[order]
    ends = np.cumsum(size)
    left = np.repeat(ends, size) - np.arange(ends[-1]) - 1
    stream = (np.repeat(code, size) >> left & 1).astype(np.uint8)
    stream = np.packbits(np.concatenate([stream, ones(-len(stream) % 8, np.uint8)])).tobytes().replace(b"\xff", b"\xff\x00")
    part = lambda kind, data: b"\xff" + bytes([kind]) + struct.pack(">H", len(data) + 2) + data
    head = part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + part(0xDB, b"\0" + bytes(steps.ravel()[zigzag].tolist()))
    frame = part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
    codes = part(0xC4, b"\x00" + tables[0][2]) + part(0xC4, b"\x10" + tables[1][2])
    return b"\xff\xd8" + head + frame + codes + part(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + stream + b"\xff\xd9"


def _encoded(pixels: DataFrame, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    alpha = F.col("a") if "a" in pixels.columns else F.lit(255)

    def run(px: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((px["y"].max() + 1, px["x"].max() + 1, 4), np.uint8)
        out[px["y"], px["x"]] = px[["r", "g", "b", "a"]].to_numpy(np.uint8)
        return pd.DataFrame({"image_id": [px["image_id"].iloc[0]], "data": [encode(out)]})

    return pixels.select("image_id", "x", "y", "r", "g", "b", alpha.alias("a")).groupBy("image_id").applyInPandas(run, "image_id long, data binary")


def png(pixels: DataFrame) -> DataFrame:
    """image_id, data: pixels(image_id, x, y, r, g, b and perhaps a) as PNG. Missing pixels are transparent; an image is one group."""
    return _encoded(pixels, encode_png)


def jpeg(pixels: DataFrame) -> DataFrame:
    """image_id, data: pixels(image_id, x, y, r, g, b) as JPEG. Opacity is dropped, missing pixels are black; an image is one group."""
    return _encoded(pixels, lambda rgba: encode_jpeg(rgba[..., :3]))


def palette_json(stats: DataFrame) -> DataFrame:
    """image_id, data: the palette's entries in order, as JSON."""
    entry = F.struct(F.col("color_index").alias("index"), F.array("r", "g", "b").alias("color"), "color_alias", "frequency", "area_percentage")
    return stats.groupBy("image_id").agg(F.to_json(F.array_sort(F.collect_list(entry)), {"ignoreNullFields": "false", "pretty": "true"}).alias("data"))


def facets_json(stats: DataFrame, neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """image_id, facet_count, facets_summary, label_bounds: what a debug file says of facets, in the order of ids."""
    own = stats.join(neighbours, ["image_id", "facet_id"], "left").join(labels.select("image_id", "facet_id", F.struct("min_x", "min_y", "width", "height").alias("box")), ["image_id", "facet_id"], "left")
    row = F.struct(F.col("facet_id").alias("id"), "color_index", "point_count", F.col("min_x").alias("bbox_min_x"), F.col("min_y").alias("bbox_min_y"), F.col("max_x").alias("bbox_max_x"), F.col("max_y").alias("bbox_max_y"), F.coalesce("neighbours", F.array().cast("array<int>")).alias("neighbour_facets"), "box")
    all_ = own.groupBy("image_id").agg(F.array_sort(F.collect_list(row), lambda a, b: a["id"] - b["id"]).alias("rows"), F.count("*").alias("facet_count"))
    return all_.select("image_id", "facet_count", F.transform("rows", lambda r: r.dropFields("box")).alias("facets_summary"), F.transform("rows", lambda r: r["box"]).alias("label_bounds"))


def place(output: str, default: str = "result") -> tuple[str, str]:
    """Folder and stem of an output: a name with an ending is a file's, others are folders."""
    p = PurePosixPath(output)
    return (str(p.parent), p.stem) if p.suffix else (output, default)


def write_files(data: DataFrame, folder: str, stem: str, ending: str, numbered: bool = True) -> None:
    """One file for each row of data(image_id, data), written by the tasks through Spark's file system, so any store will do: folder/stem-image_id.ending, or without the
    id if there is one image only."""
    kind = dict(data.dtypes)["data"]
    raw = data.select("image_id", F.encode("data", "UTF-8").alias("data") if kind == "string" else F.col("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        target, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for b in batches:
            for i, d in zip(b["image_id"], b["data"], strict=True):
                target.create_dir(base, recursive=True)
                with target.open_output_stream(f"{base}/{stem}-{i}.{ending}" if numbered else f"{base}/{stem}.{ending}") as f:
                    f.write(d)
            yield b[["image_id"]]

    raw.mapInPandas(run, "image_id long").write.format("noop").mode("overwrite").save()
