"""GeoTIFF and COG: header parser, chunk codecs, and a Spark reader and writers with one row for each chunk.

Reads striped and tiled files, one sample a chunk, plain, LZW, deflate and ZSTD, predictors 1 to 3, overviews
and sparse chunks.  Pixel-interleaved files of several bands are refused.  A reader opens the files by range: the
header, in a buffer that grows until it holds all directories, and then only the chunks that are wanted.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import Georef
from .codecs import with_sentinel

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


@dataclass
class Image:
    width: int
    height: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    chunk_w: int
    chunk_h: int
    offsets: list[int]
    sizes: list[int]
    nodata: float | None = None
    gt: list[float] | None = None
    epsg: int | None = None
    tags: dict = field(default_factory=dict)

    @property
    def wide(self) -> int:
        return -(-self.width // self.chunk_w)

    @property
    def high(self) -> int:
        return -(-self.height // self.chunk_h)

    def chunks_in(self, band: int, row0: int, col0: int, rows: int, cols: int) -> list[tuple[int, int, int]]:
        """(index, row, col) of the chunks that a region of a band touches."""
        out = []
        for cr in range(max(0, row0 // self.chunk_h), min(self.high, -(-(row0 + rows) // self.chunk_h))):
            for cc in range(max(0, col0 // self.chunk_w), min(self.wide, -(-(col0 + cols) // self.chunk_w))):
                out.append(((band - 1) * self.wide * self.high + cr * self.wide + cc, cr * self.chunk_h, cc * self.chunk_w))
        return out


def parse(data: bytes) -> list[Image]:
    """Full resolution first, then overviews in file order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("not a TIFF")
    version = struct.unpack_from(order + "H", data, 2)[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)[0]
    images = []
    while at:
        n = struct.unpack_from(order + ("Q" if big else "H"), data, at)[0]
        at += 8 if big else 2
        tags: dict = {}
        for _ in range(n):
            tag, kind = struct.unpack_from(order + "HH", data, at)
            count = struct.unpack_from(order + ("Q" if big else "I"), data, at + 4)[0]
            size, spot = count * _SIZES.get(kind, 1), at + (12 if big else 8)
            if size > (8 if big else 4):
                spot = struct.unpack_from(order + ("Q" if big else "I"), data, spot)[0]
            if kind == 2:
                tags[tag] = data[spot : spot + count].split(b"\0")[0].decode("latin-1")
            elif kind in _KINDS:
                tags[tag] = list(struct.unpack_from(f"{order}{count}{_KINDS[kind]}", data, spot))
            at += 20 if big else 12
        at = struct.unpack_from(order + ("Q" if big else "I"), data, at)[0]
        images.append(_image(tags, order))
    return images


def _image(t: dict, order: str) -> Image:
    one = lambda k, default: t.get(k, [default])[0]
    width, height, bands = one(256, 0), one(257, 0), one(277, 1)
    if bands > 1 and one(284, 1) != 2:
        raise ValueError("bands that are interleaved by pixel are not read")
    kind = {1: "u", 2: "i", 3: "f"}[one(339, 1)]
    tiled = 322 in t
    image = Image(width, height, bands, f"{kind}{one(258, 8)}", one(259, 1), one(317, 1), one(322, width), one(323, 0) if tiled else min(height, one(278, height)), t[324 if tiled else 273], t[325 if tiled else 279], tags=t | {"order": order})
    image.nodata = float(t[42113]) if t.get(42113, "").strip() else None
    if 33550 in t and 33922 in t:
        (sx, sy, _), (i, j, _, x, y, _) = t[33550][:3], t[33922][:6]
        image.gt = [x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy]
    keys = t.get(34735, [])
    for k in range(4, len(keys) - 3, 4):
        if keys[k] in (2048, 3072):
            image.epsg = keys[k + 3]
    return image


def lzw(data: bytes) -> bytes:
    """TIFF's variant: most significant bit first, 256 clears, 257 ends, codes widen one early."""
    out, table = bytearray(), [bytes([k]) for k in range(256)] + [b"", b""]
    width, bits, n, previous = 9, 0, 0, b""
    for byte in data:
        bits, n = bits << 8 | byte, n + 8
        while n >= width:
            code = bits >> n - width & (1 << width) - 1
            n -= width
            bits &= (1 << n) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                del table[258:]
                width, previous = 9, b""
                continue
            entry = table[code] if code < len(table) else previous + previous[:1]
            if previous:
                table.append(previous + entry[:1])
            out += entry
            previous = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def chunk(image: Image, data: bytes) -> np.ndarray:
    """Decoded values of a chunk, as stored."""
    order = image.tags.get("order", "<")
    kind = np.dtype(f"{order}{image.dtype[0]}{int(image.dtype[1:]) // 8}")
    if image.compression in (8, 32946):
        data = zlib.decompress(data)
    elif image.compression == 5:
        data = lzw(data)
    elif image.compression == 50000:
        import zstandard

        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=image.chunk_w * image.chunk_h * kind.itemsize)
    elif image.compression != 1:
        raise ValueError(f"compression {image.compression} is not read")
    w = image.chunk_w
    if image.predictor == 3:
        planes = np.frombuffer(data, np.uint8).reshape(-1, w * kind.itemsize).cumsum(axis=1, dtype=np.uint8)
        swapped = planes.reshape(-1, kind.itemsize, w).transpose(0, 2, 1)
        return np.ascontiguousarray(swapped).view(kind.newbyteorder(">")).reshape(-1, w)
    values = np.frombuffer(data, kind).reshape(-1, w)
    return values.cumsum(axis=1, dtype=kind.newbyteorder("=")) if image.predictor == 2 else values


def is_cog(data: bytes) -> bool:
    """Whether the ghost header behind the TIFF header says so."""
    head = data[: 16 + 4096]
    return b"GDAL_STRUCTURAL_METADATA_SIZE=" in head[:64] and b"LAYOUT=IFDS_BEFORE_DATA" in head


def encode(values: np.ndarray, dtype: str = "f32", *, gt: list[float] | None = None, nodata: float | None = None, tile: int | None = None, compression: int = 8, epsg: int | None = None) -> bytes:
    """A one-band TIFF, little-endian: striped, or tiled; plain, deflate or ZSTD."""
    h, w = values.shape
    kind = np.dtype(f"<{dtype[0]}{int(dtype[1:]) // 8}")
    cw, ch = (tile, tile) if tile else (w, min(h, max(1, 8192 // max(1, w * kind.itemsize))))
    filled = np.where(np.isnan(values), np.nan if nodata is None else nodata, values)
    parts = []
    for r in range(0, h, ch):
        for c in range(0, w, cw):
            block = filled[r : r + ch, c : c + cw]
            if tile:
                block = np.pad(block, ((0, ch - block.shape[0]), (0, cw - block.shape[1])), constant_values=0 if nodata is None else nodata)
            raw = block.astype(kind).tobytes()
            if compression == 8:
                raw = zlib.compress(raw)
            elif compression == 50000:
                import zstandard

                raw = zstandard.ZstdCompressor().compress(raw)
            parts.append(raw)
    tags: list[tuple[int, int, bytes, int]] = []
    add = lambda tag, kind, fmt, *v: tags.append((tag, kind, struct.pack("<" + fmt, *v), len(v)))
    add(256, 4, "I", w)
    add(257, 4, "I", h)
    add(258, 3, "H", int(dtype[1:]))
    add(259, 3, "H", compression)
    add(262, 3, "H", 1)
    body = 8
    starts = []
    for p in parts:
        starts.append(body)
        body += len(p)
    counts = [len(p) for p in parts]
    if tile:
        add(322, 4, "I", cw)
        add(323, 4, "I", ch)
        add(324, 4, f"{len(parts)}I", *starts)
        add(325, 4, f"{len(parts)}I", *counts)
    else:
        add(273, 4, f"{len(parts)}I", *starts)
        add(278, 4, "I", ch)
        add(279, 4, f"{len(parts)}I", *counts)
    add(277, 3, "H", 1)
    add(339, 3, "H", {"u": 1, "i": 2, "f": 3}[dtype[0]])
    if gt:
        add(33550, 12, "3d", gt[1], -gt[5], 0.0)
        add(33922, 12, "6d", 0, 0, 0, gt[0], gt[3], 0)
    if epsg:
        add(34735, 3, "8H", 1, 1, 0, 1, 3072, 0, 1, epsg)
    if nodata is not None:
        text = repr(nodata).encode() + b"\0"
        tags.append((42113, 2, text, len(text)))
    tags.sort()
    heap_at, heap, entries = body + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind_, raw, n in tags:
        if len(raw) <= 4:
            entries += struct.pack("<HHI", tag, kind_, n) + raw.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind_, n, heap_at + len(heap))
            heap += raw + b"\0" * (len(raw) % 2)
    return struct.pack("<2sHI", b"II", 42, body) + b"".join(parts) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + heap


def gdal_metadata(text: str) -> dict:
    """Scale and offset by band, statistics by band and name, and the other items of a GDAL metadata tag."""
    out: dict = {"scale": {}, "offset": {}, "statistics": {}, "items": {}}
    for item in ElementTree.fromstring(text).iterfind("Item"):
        name, value, band = item.get("name", ""), (item.text or "").strip(), int(item.get("sample", -1)) + 1
        role = item.get("role", "")
        if role in ("scale", "offset"):
            out[role][band] = float(value)
        elif name.startswith("STATISTICS_"):
            out["statistics"].setdefault(band, {})[name.removeprefix("STATISTICS_").lower()] = float(value)
        else:
            out["items"][name] = value
    return out


def _store(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://"))


def header(path: str, first: int = 1 << 16) -> list[Image]:
    """The directories of a file, read from its start in as many bytes as they need."""
    store, name = _store(path)
    with store.open_input_file(name) as f:
        size, n = f.size(), first
        while True:
            f.seek(0)
            try:
                return parse(f.read(min(n, size)))
            except (struct.error, IndexError):
                if n >= size:
                    raise ValueError(f"{path} is cut off") from None
                n *= 4


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and lengths below ``path``; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """raster_meta rows (one for each file and overview) of all files below ``path``."""

    def run(batches):
        for frame in batches:
            for name in frame["path"]:
                rows = []
                for k, i in enumerate(header(name)):
                    more = gdal_metadata(i.tags[42112]) if i.tags.get(42112) else {"scale": {}, "offset": {}}
                    rows.append({"raster_id": name, "overview": k, "rows": i.height, "cols": i.width, "bands": i.bands, "dtype": i.dtype, "nodata": i.nodata, "epsg": i.epsg, "gt": i.gt,
                                 "chunks": len(i.offsets), "scale": more["scale"].get(1), "offset": more["offset"].get(1)})
                yield pd.DataFrame(rows)

    return _files(spark, path).mapInPandas(run, "raster_id string, overview int, rows int, cols int, bands int, dtype string, nodata double, epsg int, gt array<double>, chunks int, scale double, offset double")


def read(spark: SparkSession, path: str, *, band: int = 1, overview: int = 0, region: tuple[int, int, int, int] | None = None, dtype: str | None = None) -> DataFrame:
    """cells of a band; of ``region`` (row, col, rows, cols) only the chunks that it touches are read.

    First the headers give a row for each chunk, then the chunks are read and decoded wherever their rows are dealt.
    With ``dtype`` values are cut to that type, and what it cannot hold is no data.
    """

    def cut(batches):
        for frame in batches:
            for name in frame["path"]:
                image = header(name)[overview]
                if not 1 <= band <= image.bands:
                    raise ValueError(f"band {band} of {image.bands}")
                r0, c0, rows, cols = region or (0, 0, image.height, image.width)
                found = image.chunks_in(band, r0, c0, rows, cols)
                yield pd.DataFrame([{"raster_id": name, "row0": row, "col0": col, "w": image.width, "h": image.height, "cw": image.chunk_w, "ch": image.chunk_h, "dtype": image.dtype, "compression": image.compression,
                                     "predictor": image.predictor, "nodata": image.nodata, "big": image.tags["order"] == ">", "at": image.offsets[k], "n": image.sizes[k]} for k, row, col in found])

    def decode(batches):
        for frame in batches:
            for name, part in frame.groupby("raster_id"):
                store, place = _store(name)
                with store.open_input_file(place) as f:
                    for r in part.itertuples():
                        rows, cols = min(r.ch, r.h - r.row0), min(r.cw, r.w - r.col0)
                        if not r.n:
                            values = np.full((rows, cols), np.nan)
                        else:
                            f.seek(int(r.at))
                            image = Image(r.w, r.h, 1, r.dtype, r.compression, r.predictor, r.cw, r.ch, [], [], tags={"order": ">" if r.big else "<"})
                            values = chunk(image, f.read(int(r.n)))[:rows, :cols].astype(float)
                            if r.nodata is not None and not np.isnan(r.nodata):
                                values[values == r.nodata] = np.nan
                        at = np.indices((rows, cols)).reshape(2, -1)
                        yield pd.DataFrame({"raster_id": name, "row": at[0] + r.row0, "col": at[1] + r.col0, "value": values.ravel()})

    chunks = _files(spark, path).mapInPandas(cut, "raster_id string, row0 int, col0 int, w int, h int, cw int, ch int, dtype string, compression int, predictor int, nodata double, big boolean, at long, n long")
    cells = chunks.repartition("raster_id", "row0", "col0").mapInPandas(decode, "raster_id string, row int, col int, value double")
    cells = cells.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    if region:
        r0, c0, rows, cols = region
        cells = cells.where(F.col("row").between(r0, r0 + rows - 1) & F.col("col").between(c0, c0 + cols - 1))
    if dtype:
        from ..operators.algebra import cast

        cells = cast(cells, dtype)
    return cells


# ---- writers


def _pressed(block: np.ndarray, dtype: str, nodata: float | None, compression: int, predictor: int) -> bytes:
    kind = np.dtype(f"<{dtype[0]}{int(dtype[1:]) // 8}")
    if dtype[0] == "f":
        stored = np.where(np.isnan(block), np.nan if nodata is None else nodata, block).astype(kind)
    else:
        typed = with_sentinel(block, dtype)
        stored = np.where(np.isnan(block), typed if nodata is None else kind.type(nodata), typed).astype(kind)
    if predictor == 2:
        stored = np.concatenate([stored[:, :1], np.diff(stored, axis=1)], axis=1).astype(kind)
        raw = stored.tobytes()
    elif predictor == 3:
        planes = stored.astype(kind.newbyteorder(">")).view(np.uint8).reshape(*stored.shape, kind.itemsize).transpose(0, 2, 1).reshape(len(stored), -1)
        raw = np.concatenate([planes[:, :1], np.diff(planes, axis=1)], axis=1).astype(np.uint8).tobytes()
    else:
        raw = stored.tobytes()
    if compression == 8:
        return zlib.compress(raw)
    if compression == 50000:
        import zstandard

        return zstandard.ZstdCompressor().compress(raw)
    return raw


def chunks_of(cells: DataFrame, rows: int, cols: int, level: int = 0, *, tile: int = 256, dtype: str = "f32", nodata: float | None = None, compression: int = 8, predictor: int = 1, sparse: bool = False) -> DataFrame:
    """(raster_id, level, chunk, data): cells as encoded square chunks; a task holds a chunk.  Of ``sparse`` files a chunk
    without data has none."""
    wide = -(-cols // tile)

    def press(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        block = np.full((tile, tile), np.nan)
        block[frame["row"].to_numpy() % tile, frame["col"].to_numpy() % tile] = frame["value"].astype(float)
        empty = sparse and np.isnan(block).all()
        return pd.DataFrame({"raster_id": [first["raster_id"]], "level": [level], "chunk": [int(first["chunk"])], "data": [b"" if empty else _pressed(block, dtype, nodata, compression, predictor)]})

    at = F.expr(f"cast((row div {tile}) * {wide} + col div {tile} as int)")
    return cells.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)).withColumn("chunk", at).groupBy("raster_id", "chunk").applyInPandas(press, "raster_id string, level int, chunk int, data binary")


def _directory(g: Georef, level: int, rows: int, cols: int, sizes: list[int], at: int, where: int, last: bool, *, tile: int, dtype: str, nodata: float | None, compression: int, predictor: int, epsg: int | None) -> bytes:
    """One image's directory, to lie at ``where``, of chunks that follow each other from ``at``."""
    starts, spot = [], at
    for n in sizes:
        starts.append(spot if n else 0)
        spot += n
    tags = []
    add = lambda tag, kind, fmt, *v: tags.append((tag, kind, struct.pack("<" + fmt, *v), len(v)))
    if level:
        add(254, 4, "I", 1)
    for tag, kind, fmt, v in ((256, 4, "I", cols), (257, 4, "I", rows), (258, 3, "H", int(dtype[1:])), (259, 3, "H", compression), (262, 3, "H", 1), (277, 3, "H", 1), (317, 3, "H", predictor), (322, 4, "I", tile), (323, 4, "I", tile), (339, 3, "H", {"u": 1, "i": 2, "f": 3}[dtype[0]])):
        add(tag, kind, fmt, v)
    add(324, 16, f"{len(sizes)}Q", *starts)
    add(325, 4, f"{len(sizes)}I", *sizes)
    if not level:
        add(33550, 12, "3d", g.cx, -g.cy, 0.0)
        add(33922, 12, "6d", 0, 0, 0, g.x0, g.y0, 0)
        if epsg:
            geographic = epsg in (4326, 4258, 4313)
            add(34735, 3, "12H", 1, 1, 0, 2, 1024, 0, 1, 2 if geographic else 1, 2048 if geographic else 3072, 0, 1, epsg)
    if nodata is not None:
        text = repr(nodata).encode() + b"\0"
        tags.append((42113, 2, text, len(text)))
    tags.sort()
    heap_at = where + 8 + 20 * len(tags) + 8
    entries, heap = b"", b""
    for tag, kind, raw, n in tags:
        if len(raw) <= 8:
            entries += struct.pack("<HHQ", tag, kind, n) + raw.ljust(8, b"\0")
        else:
            entries += struct.pack("<HHQQ", tag, kind, n, heap_at + len(heap))
            heap += raw + b"\0" * (-len(raw) % 8)
    size = heap_at - where + len(heap)
    return struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0 if last else where + size) + heap


_GHOST = b"LAYOUT=IFDS_BEFORE_DATA\nBLOCK_ORDER=ROW_MAJOR\nBLOCK_LEADER=NONE\n"


def file_head(g: Georef, sizes: list[list[int]], **options) -> bytes:
    """All that comes before the chunks of a cloud-optimised BigTIFF: ``sizes`` are the chunks' bytes, level by level."""
    ghost = b"GDAL_STRUCTURAL_METADATA_SIZE=%06d bytes\n" % len(_GHOST) + _GHOST
    start = 16 + len(ghost) + -len(ghost) % 8

    def build(data_at: int) -> bytes:
        out, spot = b"", data_at
        for level, n in enumerate(sizes):
            rows, cols = -(-g.rows // 2**level), -(-g.cols // 2**level)
            out += _directory(g, level, rows, cols, n, spot, start + len(out), level == len(sizes) - 1, **options)
            spot += sum(n)
        return out

    directories = build(0)
    directories = build(start + len(directories))
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, start) + ghost.ljust(start - 16, b"\0") + directories


def write_cog(cells: DataFrame, g: Georef, uri: str, *, levels: int = 1, tile: int = 256, dtype: str = "f32", nodata: float | None = None, compression: int = 8, predictor: int = 1, sparse: bool = False, epsg: int | None = 3857, how: str = "mean") -> DataFrame:
    """A cloud-optimised GeoTIFF of each raster of ``cells`` below ``uri``, with ``levels`` - 1 overviews; returns (raster_id, path, bytes).

    Chunks are encoded in parallel and written to a table; then a task for each file streams its chunks in order behind
    the head, which their sizes make.  A negative no-data value of an unsigned type is refused.
    """
    from ..operators.tiling import downsample
    from ..session import checkpointed

    if nodata is not None and nodata < 0 and dtype[0] == "u":
        raise ValueError(f"{nodata} is no value of the type {dtype}")
    parts, now = None, cells
    for level in range(levels):
        part = chunks_of(now, -(-g.rows // 2**level), -(-g.cols // 2**level), level, tile=tile, dtype=dtype, nodata=nodata, compression=compression, predictor=predictor, sparse=sparse)
        parts = part if parts is None else parts.unionByName(part)
        now = downsample(now, 2, how)
    made = checkpointed(parts)
    counts = [-(-(-(-g.rows // 2**k)) // tile) * -(-(-(-g.cols // 2**k)) // tile) for k in range(levels)]
    sizes = made.groupBy(F.col("raster_id").alias("__name")).agg(F.collect_list(F.struct("level", "chunk", F.length("data").alias("n"))).alias("sizes"))  # a few bytes for each chunk
    fed = made.join(sizes, F.col("raster_id") == F.col("__name")).withColumn("sizes", F.when((F.col("level") == 0) & (F.col("chunk") == 0), F.col("sizes"))).drop("__name")
    options = {"tile": tile, "dtype": dtype, "nodata": nodata, "compression": compression, "predictor": predictor, "epsg": epsg}

    def stream(batches):
        out = name = None
        written = 0

        def close():
            out.close()
            store.move(temporary, f"{base}/{name}.tif")
            return pd.DataFrame({"raster_id": [name], "path": [f"{uri}/{name}.tif"], "bytes": [written]})

        store, base = _store(uri)
        for frame in batches:
            for raster, level, part, data, found in frame[["raster_id", "level", "chunk", "data", "sizes"]].itertuples(index=False):
                if raster != name:
                    if out is not None:
                        yield close()
                    name, written = raster, 0
                    listed = [[0] * n for n in counts]
                    for s in found:
                        listed[s["level"]][s["chunk"]] = s["n"]
                    store.create_dir(base, recursive=True)
                    temporary = f"{base}/_{name}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                    head = file_head(g, listed, **options)
                    out.write(head)
                    written += len(head)
                out.write(data)
                written += len(data)
        if out is not None:
            yield close()

    ordered = fed.repartition("raster_id").sortWithinPartitions("raster_id", "level", "chunk")
    return checkpointed(ordered.mapInPandas(stream, "raster_id string, path string, bytes long"))
