"""GeoTIFF (BigTIFF) rasters in plain Python.

Executors turn cells into compressed tiles and write them; only the list of tiles
passes through the driver, which adds the directories.
"""

from __future__ import annotations

import functools
import os
import re
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellmill.functions.crs import CRS
from cellmill.functions.grid import BBox, GridSpec
from cellmill.operators.raster import bands_of, pyramid

#: TIFF's compression codes.
CODES = {"NONE": 1, "LZW": 5, "DEFLATE": 8, "ZSTD": 50000}


@dataclass(frozen=True)
class GeoTiffOptions:
    compress: str = "DEFLATE"
    tile: int = 256
    overviews: bool = False
    level: int = 6


def lzw(data: bytes) -> bytes:
    """TIFF's variant: most significant bit first, widths of 9 to 12 bits, the width grows one code early."""
    out, hold, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal hold, bits
        hold, bits = (hold << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((hold >> bits) & 255)
        hold &= (1 << bits) - 1

    table, width, word = {bytes([i]): i for i in range(256)}, 9, b""
    put(256, 9)
    for b in data:
        longer = word + bytes([b])
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = len(table) + 2
        word = bytes([b])
        size = len(table) + 2
        if size >= 4094:
            put(256, width)
            table, width = {bytes([i]): i for i in range(256)}, 9
        elif size >= (1 << width):
            width += 1
    if word:
        put(table[word], width)
        if len(table) + 3 >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((hold << (8 - bits)) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out, table, width, hold, bits, last = [], [], 9, 0, 0, None
    for byte in data:
        hold, bits = (hold << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, hold = hold >> bits, hold & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        if last is not None:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= (1 << width) and width < 12:
            width += 1
    return b"".join(out)


def _squeeze(raw: bytes, o: GeoTiffOptions) -> bytes:
    match o.compress:
        case "NONE":
            return raw
        case "DEFLATE":
            return zlib.compress(raw, o.level)
        case "LZW":
            return lzw(raw)
        case "ZSTD":
            return pa.Codec("zstd", o.level).compress(raw, asbytes=True)
    raise ValueError(f"unknown compression {o.compress!r}")


def _unsqueeze(raw: bytes, code: int, size: int) -> bytes:
    if code in (8, 32946):
        return zlib.decompress(raw)
    if code == 5:
        return unlzw(raw)
    return pa.Codec("zstd").decompress(raw, size, asbytes=True) if code == 50000 else raw


def tiles_of(raster: DataFrame, width: int, height: int, o: GeoTiffOptions) -> DataFrame:
    """tile (number in file order) and the compressed bytes of it in each band, for tiles with any cell; sorted by tile."""
    bands, t, across = bands_of(raster), o.tile, -(-width // o.tile)
    number = F.floor(F.col("row") / t).cast("long") * across + F.floor(F.col("col") / t)
    cells = raster.select(number.alias("tile"), (F.col("row") % t * t + F.col("col") % t).cast("int").alias("at"), *[F.col(f"`{b}`").cast("float").alias(f"b{k}") for k, b in enumerate(bands)])

    def make(group: pa.Table) -> pa.Table:
        at, out = group.column("at").to_numpy(), []
        for k in range(len(bands)):
            block = np.full(t * t, np.nan, "<f4")
            block[at] = group.column(f"b{k}").to_numpy()
            out.append(_squeeze(block.tobytes(), o))
        return pa.table({"tile": group.column("tile")[:1], "bytes": pa.array([out], pa.list_(pa.binary()))})

    return cells.groupBy("tile").applyInArrow(make, "tile long, bytes array<binary>")


INDEX = "level int, tile long, band int, part string, at long, size long"


def _save_tiles(tiles: DataFrame, folder: str) -> list:
    """Writes level, tile, bytes into one file per task and returns where each tile lies: rows of INDEX.  A task that is
    repeated writes another file, and only that of the attempt that counts is named."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, at, f = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0, None
        for batch in batches:
            rows = []
            for level, tile, packed in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if f is None:
                    os.makedirs(folder, exist_ok=True)
                    f = open(f"{folder}/{part}", "wb")
                for band, raw in enumerate(packed):
                    f.write(raw)
                    rows.append((level, tile, band, part, at, len(raw)))
                    at += len(raw)
            if rows:
                f.flush()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["level", "tile", "band", "part", "at", "size"])
        if f:
            f.close()

    return tiles.select("level", "tile", "bytes").mapInArrow(save, INDEX).collect()


def _copy_parts(spark: SparkSession, folder: str, path: str, parts: list[tuple[str, int]], most: int = 32 << 20) -> None:
    """Copies part files to their places in the file: many bytes by tasks, each one part, few by the driver."""

    def copy(part: str, to: int) -> None:
        with open(f"{folder}/{part}", "rb") as source, open(path, "r+b") as f:
            f.seek(to)
            shutil.copyfileobj(source, f, 1 << 22)

    if sum(os.path.getsize(f"{folder}/{p}") for p, _ in parts) <= most:
        for part, to in parts:
            copy(part, to)
        return

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                copy(part, to)  # the same bytes at the same place if it is repeated
            yield batch

    spark.createDataFrame(parts, "part string, at long").repartition(len(parts)).mapInArrow(work, "part string, at long").collect()


class TiledGeoTiffWriter:
    """write_tile in any order, then close.  Tiles that never come share one empty tile."""

    def __init__(self, path: str, grid: GridSpec, bands: list[str], options: GeoTiffOptions = GeoTiffOptions()):
        self.f = open(path.removeprefix("file://"), "wb")
        self.grid, self.bands, self.o = grid, bands, options
        self.f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0))
        self.levels: list[tuple[int, int, dict[tuple[int, int], tuple[int, int]]]] = []
        self.level(grid.width, grid.height)
        empty = _squeeze(np.full(options.tile**2, np.nan, "<f4").tobytes(), options)
        self.empty = (self._append(empty), len(empty))

    def level(self, width: int, height: int) -> None:
        """The following tiles belong to an image of this size; the first level is the raster itself."""
        self.levels.append((width, height, {}))

    def _append(self, raw: bytes) -> int:
        at = self.f.seek(0, 2)
        self.f.write(raw)
        return at

    def reserve(self, size: int) -> int:
        """A place of this size for bytes that others write before close."""
        at = self.f.seek(0, 2)
        self.f.truncate(at + size)
        return at

    def place(self, level: int, tile: int, band: int, at: int, size: int) -> None:
        self.levels[level][2][band, tile] = (at, size)

    def write_packed(self, tile: int, packed: list[bytes]) -> None:
        for band, raw in enumerate(packed):
            self.levels[-1][2][band, tile] = (self._append(raw), len(raw))

    def write_tile(self, tile_row: int, tile_col: int, values: np.ndarray) -> None:
        """values: (bands, rows, cols), at most a tile; edge tiles may be smaller."""
        across = -(-self.levels[-1][0] // self.o.tile)
        packed = []
        for band in values:
            block = np.full((self.o.tile, self.o.tile), np.nan, "<f4")
            block[: band.shape[0], : band.shape[1]] = band
            packed.append(_squeeze(block.tobytes(), self.o))
        self.write_packed(tile_row * across + tile_col, packed)

    def _tags(self, k: int) -> list[tuple[int, int, list | bytes]]:
        width, height, places = self.levels[k]
        n = -(-width // self.o.tile) * -(-height // self.o.tile)
        found = [places.get((b, i), self.empty) for b in range(len(self.bands)) for i in range(n)]
        nb = len(self.bands)
        tags: list[tuple[int, int, list | bytes]] = [
            (254, 4, [1 if k else 0]), (256, 4, [width]), (257, 4, [height]), (258, 3, [32] * nb), (259, 3, [CODES[self.o.compress]]), (262, 3, [1]), (277, 3, [nb]),
            (284, 3, [2]), (322, 4, [self.o.tile]), (323, 4, [self.o.tile]), (324, 16, [a for a, _ in found]), (325, 16, [b for _, b in found]), (339, 3, [3] * nb),
            (42113, 2, b"nan\0"),
        ]
        if nb > 1:
            tags.append((338, 3, [0] * (nb - 1)))
        if k == 0:
            g = self.grid
            items = "".join(f'<Item name="DESCRIPTION" sample="{i}" role="description">{escape(b)}</Item>' for i, b in enumerate(self.bands))
            tags += [(33550, 12, [g.cell_x, -g.cell_y, 0.0]), (33922, 12, [0.0, 0.0, 0.0, g.bounds.min_x, g.bounds.max_y, 0.0])]
            tags.append((42112, 2, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0"))
            if g.crs.known:
                text = (g.crs.wkt or f"EPSG:{g.crs.epsg}").replace("|", "/") + "|"
                geographic = g.crs.is_geographic
                keys = [1, 1, 0, 0, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 1026, 34737, len(text), 0]
                if g.crs.epsg:
                    keys += [2048 if geographic else 3072, 0, 1, g.crs.epsg if g.crs.epsg < 65536 else 32767]
                keys[3] = len(keys) // 4 - 1
                tags += [(34735, 3, keys), (34737, 2, text.encode() + b"\0")]
        return sorted(tags)

    def close(self) -> None:
        heads = []
        for k in range(len(self.levels)):
            entries = []
            for tag, kind, values in self._tags(k):
                form = {2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}[kind]
                raw = values if kind == 2 else struct.pack(f"<{len(values)}{form}", *values)
                place = raw.ljust(8, b"\0") if len(raw) <= 8 else struct.pack("<Q", self._append(raw))
                entries.append(struct.pack("<HHQ", tag, kind, len(values)) + place)
            heads.append(self._append(struct.pack("<Q", len(entries)) + b"".join(entries) + bytes(8)) + 8 + 20 * len(entries))
        for here, after in zip(heads, heads[1:], strict=False):
            self.f.seek(here)
            self.f.write(struct.pack("<Q", self._start(after)))
        self.f.seek(8)
        self.f.write(struct.pack("<Q", self._start(heads[0])))
        self.f.close()

    def _start(self, link: int) -> int:
        """Begin of the directory whose link field is at this place."""
        k = [len(self._tags(i)) for i in range(len(self.levels))]
        return next(link - 8 - 20 * n for n in k if self._is_head(link - 8 - 20 * n, n))

    def _is_head(self, at: int, n: int) -> bool:
        self.f.flush()
        with open(self.f.name, "rb") as f:
            f.seek(at)
            return struct.unpack("<Q", f.read(8))[0] == n


def write_geotiff(raster: DataFrame, grid: GridSpec, path: str, options: GeoTiffOptions = GeoTiffOptions()) -> None:
    """Float32 bands with their names, NaN as no data, geotransform, CRS and, with overviews, averaged levels.

    One job makes and compresses the tiles of all levels, each level from the sums and counts of the one before, and its
    tasks write them beside the file; they then go to their places, and only their list passes through the driver.  All
    executors must see the path.
    """
    levels = {1: raster} | (pyramid(raster, grid) if options.overviews else {})
    sizes = [(-(-grid.width // n), -(-grid.height // n)) for n in levels]
    tiles = [tiles_of(df, w, h, options).withColumn("level", F.lit(k)) for k, (df, (w, h)) in enumerate(zip(levels.values(), sizes, strict=True))]
    plain = path.removeprefix("file://")
    folder = f"{plain}.parts-{uuid.uuid4().hex}"
    index = _save_tiles(functools.reduce(lambda a, b: a.unionByName(b), tiles), folder)
    writer = TiledGeoTiffWriter(path, grid, bands_of(raster), options)
    for width, height in sizes[1:]:
        writer.level(width, height)
    ends: dict[str, int] = {}
    for r in index:
        ends[r["part"]] = max(ends.get(r["part"], 0), r["at"] + r["size"])
    places = {part: writer.reserve(size) for part, size in sorted(ends.items())}
    for r in index:
        writer.place(r["level"], r["tile"], r["band"], places[r["part"]] + r["at"], r["size"])
    writer.f.flush()
    _copy_parts(raster.sparkSession, folder, plain, list(places.items()))
    writer.close()
    shutil.rmtree(folder, ignore_errors=True)


@dataclass(frozen=True)
class GeoTiffInfo:
    width: int
    height: int
    bands: tuple[str, ...]
    crs: CRS
    bounds: BBox
    tile: tuple[int, int]
    compression: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    levels: int


def read_geotiff_info(path: str, level: int = 0) -> GeoTiffInfo:
    """Of classic and big TIFF, little-endian, tiled or in strips, float32, bands one after another.  level: 0 for the raster
    itself, 1, 2, ... for its overviews, which have the names and the box of the raster."""
    with open(path.removeprefix("file://"), "rb") as f:
        head = f.read(16)
        if head[:2] != b"II" or head[2] not in (42, 43):
            raise ValueError(f"{path}: no little-endian TIFF")
        big = head[2] == 43
        (at,) = struct.unpack_from("<Q", head, 8) if big else struct.unpack_from("<I", head, 4)
        first, levels, whole = None, 0, {}
        while at:
            f.seek(at)
            (n,) = struct.unpack("<Q", f.read(8)) if big else struct.unpack("<H", f.read(2))
            size = 20 if big else 12
            raw = f.read(n * size)
            (after,) = struct.unpack("<Q", f.read(8)) if big else struct.unpack("<I", f.read(4))
            if levels in (0, level):
                first = {}
                for k in range(n):
                    tag, kind = struct.unpack_from("<HH", raw, k * size)
                    (count,) = struct.unpack_from("<Q" if big else "<I", raw, k * size + 4)
                    form, width = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 16: ("Q", 8)}.get(kind, ("B", 1))
                    place = k * size + (12 if big else 8)
                    if count * width <= (8 if big else 4):
                        own = raw[place : place + count * width]
                    else:
                        f.seek(struct.unpack_from("<Q" if big else "<I", raw, place)[0])
                        own = f.read(count * width)
                    first[tag] = own.rstrip(b"\0").decode() if kind == 2 else struct.unpack(f"<{count}{form}", own)
                whole = whole or first
            levels, at = levels + 1, after
    if not 0 <= level < levels:
        raise IndexError(f"{path} has no level {level}")
    t = first
    w, h, nb = t[256][0], t[257][0], t.get(277, (1,))[0]
    if t.get(258, (0,))[0] != 32 or t.get(339, (1,))[0] != 3:
        raise ValueError(f"{path}: only float32 bands can be read")
    if nb > 1 and t.get(284, (1,))[0] != 2:
        raise ValueError(f"{path}: only separate bands can be read")
    found = dict((int(i), unescape(n)) for i, n in re.findall(r'sample="(\d+)" role="description">([^<]*)<', whole.get(42112, "")))
    sx, sy = t[33550][:2] if 33550 in t else tuple(a * whole[k][0] / t[k][0] for a, k in zip(whole.get(33550, (1.0, 1.0))[:2], (256, 257), strict=True))
    t = whole | t
    i, j, _, x, y, _ = t[33922][:6] if 33922 in t else (0, 0, 0, 0.0, 0.0, 0)
    x, y = x - i * sx, y + j * sy
    keys = t.get(34735, ())
    code = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (2048, 3072)), 0)
    wkt = t.get(34737, "").split("|")[0]
    tile = (t[323][0], t[322][0]) if 322 in t else (t.get(278, (h,))[0], w)
    offsets, sizes = (t[324], t[325]) if 324 in t else (t[273], t[279])
    bands = tuple(found.get(k, f"band{k + 1}") for k in range(nb))
    return GeoTiffInfo(w, h, bands, CRS(wkt if "[" in wkt else "", code), BBox(x, y - h * sy, x + w * sx, y), tile, t.get(259, (1,))[0], offsets, sizes, levels)


def read_block(path: str, info: GeoTiffInfo, band: int, number: int) -> tuple[int, int, np.ndarray]:
    """(first row, first column, values) of a tile or strip, clipped to the raster."""
    th, tw = info.tile
    across, down = -(-info.width // tw), -(-info.height // th)
    k = band * across * down + number
    with open(path.removeprefix("file://"), "rb") as f:
        f.seek(info.offsets[k])
        raw = _unsqueeze(f.read(info.sizes[k]), info.compression, 4 * th * tw)
    r, c = number // across * th, number % across * tw
    block = np.frombuffer(raw, "<f4")
    block = block[: len(block) // tw * tw].reshape(-1, tw)
    return r, c, block[: info.height - r, : info.width - c]


def read_geotiff_band(path: str, band: int = 0, level: int = 0) -> np.ndarray:
    info = read_geotiff_info(path, level)
    out = np.full((info.height, info.width), np.nan, np.float32)
    for k in range(-(-info.width // info.tile[1]) * -(-info.height // info.tile[0])):
        r, c, block = read_block(path, info, band, k)
        out[r : r + block.shape[0], c : c + block.shape[1]] = block
    return out


def read_geotiff(spark: SparkSession, path: str, skip_nan: bool = True, level: int = 0) -> DataFrame:
    """row, col and the bands, one task per few tiles.  All executors must see the path.  level: see read_geotiff_info."""
    info = read_geotiff_info(path, level)
    n = -(-info.width // info.tile[1]) * -(-info.height // info.tile[0])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                blocks = [read_block(path, info, b, k) for b in range(len(info.bands))]
                r, c, first = blocks[0]
                rows, cols = np.indices(first.shape, np.int32)
                values = [b.ravel() for _, _, b in blocks]
                keep = ~np.all(np.isnan(values), 0) if skip_nan else np.ones(first.size, bool)
                columns = [(rows.ravel() + r)[keep], (cols.ravel() + c)[keep], *[v[keep] for v in values]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "col", *info.bands])

    schema = "row int, col int" + "".join(f", `{b}` float" for b in info.bands)
    return spark.range(0, n, 1, max(1, min(n // 4, 4096))).mapInArrow(read, schema)
