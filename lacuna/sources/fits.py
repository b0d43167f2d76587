"""FITS images as a Spark source: byte ranges of the image are partitions, and a region reads only its own rows.

``spark.dataSource.register(Fits)``, then ``spark.read.format("lacuna_fits").option("region", "0:10,5:9").load(path)`` gives
(iy, ix, v). path is a file or a folder of bands, as the writer makes them, in any store that pyarrow.fs opens on
driver and executors (a shared folder, S3, HDFS with its client).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Sizes of the format (fixed values): a block, and a header card.
BLOCK, CARD = 2880, 80
#: Numpy types of BITPIX (fixed values); data are big-endian.
KINDS = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}
#: Bytes that one partition reads, rows of a written band, bytes of a row from which the columns of a region are read row by row.
PARTITION_BYTES, BAND_ROWS, WIDE_ROW = 64 << 20, 1_024, 64 << 10
#: Pixels of one Arrow batch.
BATCH = 1 << 20

SCHEMA = "iy long, ix long, v double"
#: Header card with the number of a band's first row in the whole image.
FIRST_ROW = "ROW0"


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Image:
    """Where the pixels of one file lie."""

    path: str
    at: int
    bits: int
    height: int
    width: int
    first: int = 0
    scale: float = 1.0
    zero: float = 0.0
    blank: int | None = None

    @property
    def item(self) -> int:
        return abs(self.bits) // 8


def _value(text: str):
    text = text.strip()
    if text.startswith("'"):
        return text[1 : text.rfind("'")].rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def _header(stream) -> dict:
    """Cards of the header unit at the stream's place; {} at the end of the file."""
    cards: dict = {}
    while True:
        block = stream.read(BLOCK)
        if not block and not cards:
            return {}
        if len(block) < BLOCK:
            raise ValueError("the header has no end")
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            name = card[:8].strip()
            if name == "END":
                return cards
            if card[8:10] == "= ":
                cards.setdefault(name, _value(card[10:]))


def image_of(store: fs.FileSystem, path: str) -> Image:
    """The first header unit of a file that has data; it must be an image of two axes (further ones of length 1)."""
    with store.open_input_file(path) as f:
        while head := _header(f):
            axes = [head[f"NAXIS{k + 1}"] for k in range(head.get("NAXIS", 0))]
            size = abs(head.get("BITPIX", 8)) // 8 * head.get("GCOUNT", 1) * (head.get("PCOUNT", 0) + int(np.prod(axes, dtype=np.int64))) if axes else 0
            if size:
                if head.get("XTENSION", "IMAGE") != "IMAGE" or len(axes) < 2 or any(n != 1 for n in axes[2:]):
                    raise ValueError(f"{path} holds no image of two axes")
                return Image(path, f.tell(), head["BITPIX"], axes[1], axes[0], head.get(FIRST_ROW, 0), head.get("BSCALE", 1.0), head.get("BZERO", 0.0), head.get("BLANK"))
            f.seek(f.tell() + -(-size // BLOCK) * BLOCK)
    raise ValueError(f"{path} holds no image")


def images(path: str) -> list[Image]:
    """The image of a file, or the bands of a folder by their first row; they must cover the rows without a gap."""
    store, inside = open_store(path)
    if store.get_file_info(inside).type != fs.FileType.Directory:
        return [image_of(store, inside)]
    names = [i.path for i in store.get_file_info(fs.FileSelector(inside)) if i.path.lower().endswith((".fits", ".fit", ".fts"))]
    found = sorted((image_of(store, n) for n in names), key=lambda i: i.first)
    ends = 0
    for i in found:
        if i.first != ends or i.width != found[0].width:
            raise ValueError(f"bands of {path} don't meet at row {ends}")
        ends += i.height
    return found


@dataclass
class Rows(InputPartition):
    """Rows (of the file) and columns that one task reads."""

    image: Image
    low: int
    high: int
    left: int
    right: int

    def ranges(self) -> list[tuple[int, int]]:
        """(place, bytes) to read: one run where rows are short or wanted nearly whole, else the wanted columns of each row."""
        i, width = self.image, self.right - self.left
        at = lambda row: i.at + (row * i.width + self.left) * i.item
        if i.width * i.item < WIDE_ROW or 2 * width > i.width:
            return [(at(self.low), ((self.high - self.low - 1) * i.width + width) * i.item)]
        return [(at(row), width * i.item) for row in range(self.low, self.high)]


def parse_region(region: str | None, height: int, width: int) -> tuple[int, int, int, int]:
    """(top, bottom, left, right) of "top:bottom,left:right", by the rules of slices: parts may be absent or count from the end."""
    parts = (region or "").split(",")
    if len(parts) > 2:
        raise ValueError(f"a region has rows and columns, not {region!r}")
    out: list[int] = []
    for part, n in zip([*parts, ""][:2], (height, width), strict=True):
        ends = (part.strip() or ":").split(":")
        if len(ends) != 2:
            raise ValueError(f"a region's part is low:high, not {part!r}")
        low, high, _ = slice(*(int(e) if e.strip() else None for e in ends)).indices(n)
        out += [low, max(low, high)]
    return out[0], out[1], out[2], out[3]


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.region = options["path"], options.get("region")
        self.bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Rows]:
        found = images(self.path)
        if not found:
            return []
        top, bottom, left, right = parse_region(self.region, sum(i.height for i in found), found[0].width)
        out = []
        for i in found:
            low, high = max(top - i.first, 0), min(bottom - i.first, i.height)
            step = max(1, self.bytes // max(1, i.width * i.item))
            out += [Rows(i, at, min(at + step, high), left, right) for at in range(low, high, step) if right > left]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark gives where there are no partitions
            return
        i, width = partition.image, partition.right - partition.left
        store, _ = open_store(self.path)
        whole = len(partition.ranges()) == 1
        with store.open_input_file(i.path) as f:
            per = max(1, BATCH // max(1, i.width if whole else width))
            for low in range(partition.low, partition.high, per):
                part = Rows(i, low, min(low + per, partition.high), partition.left, partition.right)
                rows = part.high - part.low
                if whole:
                    data = f.read_at(((rows - 1) * i.width + width) * i.item, part.image.at + (low * i.width + part.left) * i.item)
                    flat = np.frombuffer(data, KINDS[i.bits])
                    raw = np.lib.stride_tricks.as_strided(flat, (rows, width), (i.width * i.item, i.item))
                else:
                    raw = np.array([np.frombuffer(f.read_at(n, at), KINDS[i.bits]) for at, n in part.ranges()])
                v = raw.astype(np.float64) * i.scale + i.zero
                if i.blank is not None and i.bits > 0:
                    v[raw == i.blank] = np.nan
                iy = np.repeat(np.arange(low, part.high) + i.first, width)
                ix = np.tile(np.arange(part.left, part.right), rows)
                yield pa.RecordBatch.from_arrays([pa.array(iy), pa.array(ix), pa.array(v.ravel())], names=["iy", "ix", "v"])


def _cards(height: int, width: int, first: int) -> bytes:
    rows = [("SIMPLE", "T"), ("BITPIX", -64), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", height), (FIRST_ROW, first)]
    text = "".join(f"{k:<8}= {v:>20}".ljust(CARD) for k, v in rows) + "END".ljust(CARD)
    return text.ljust(-(-len(text) // BLOCK) * BLOCK).encode()


class Writer(DataSourceArrowWriter):
    """Bands of BAND_ROWS rows, one file each. Rows come in order of (iy, ix), and all rows of a band to one task; absent pixels become NaN."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.height, self.width = options["path"], int(options["height"]), int(options["width"])
        self.band = int(options.get("bandrows", BAND_ROWS))
        store, inside = open_store(self.path)
        if overwrite and store.get_file_info(inside).type == fs.FileType.Directory:
            store.delete_dir_contents(inside)
        store.create_dir(inside, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, inside = open_store(self.path)
        now, out, name, done = None, None, "", 0

        def fill(to: int) -> None:
            """NaN up to a place of the band."""
            nonlocal done
            while done < to:
                n = min(to - done, BATCH)
                out.write(np.full(n, np.nan, ">f8").tobytes())
                done += n

        def close() -> None:
            if out is None:
                return
            pixels = min(self.band, self.height - now * self.band) * self.width
            fill(pixels)
            out.write(b"\0" * (-pixels * 8 % BLOCK))
            out.close()
            store.move(name, f"{inside}/band-{now:08d}.fits")  # a task that runs again replaces the same file

        for batch in iterator:
            iy, ix, v = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            at = 0
            while at < len(iy):
                band = int(iy[at] // self.band)
                to = int(np.searchsorted(iy // self.band, band, side="right"))
                if band != now:
                    close()
                    now, done, name = band, 0, f"{inside}/_{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                    out.write(_cards(min(self.band, self.height - band * self.band), self.width, band * self.band))
                places = (iy[at:to] - band * self.band) * self.width + ix[at:to]
                if done == places[0] and places[-1] - places[0] == len(places) - 1:
                    out.write(v[at:to].astype(">f8").tobytes())
                    done += len(places)
                else:
                    for place, value in zip(places.tolist(), v[at:to].tolist(), strict=True):
                        fill(place)
                        out.write(np.array(value, ">f8").tobytes())
                        done += 1
                at = to
        close()
        return WriterCommitMessage()


class Fits(DataSource):
    """Read: options path, region, partitionBytes. Write: height, width, bandRows; use write_fits, which orders the pixels."""

    @classmethod
    def name(cls) -> str:
        return "lacuna_fits"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def write_fits(pixels: DataFrame, path: str, height: int, width: int, band_rows: int = BAND_ROWS) -> None:
    """(iy, ix, v) as a folder of FITS bands. Bands are dealt over tasks, and a task streams its pixels without holding a line.

    Pixels outside the raster are left out, of repeated ones the largest counts; absent and null ones become NaN.
    """
    spark = pixels.sparkSession
    spark.dataSource.register(Fits)
    inside = pixels.where((F.col("iy") >= 0) & (F.col("iy") < height) & (F.col("ix") >= 0) & (F.col("ix") < width))
    inside = inside.select(F.col("iy").cast("long").alias("iy"), F.col("ix").cast("long").alias("ix"), F.col("v").cast("double").alias("v"))
    corners = spark.range(0, height if width else 0, band_rows).select(F.col("id").alias("iy"), F.lit(0).cast("long").alias("ix"), F.lit(None).cast("double").alias("v"))
    once = inside.unionByName(corners).groupBy("iy", "ix").agg(F.coalesce(F.max("v"), F.lit(float("nan"))).alias("v"))
    dealt = once.repartition(F.floor(F.col("iy") / band_rows)).sortWithinPartitions("iy", "ix")
    dealt.write.format("lacuna_fits").option("height", height).option("width", width).option("bandRows", band_rows).mode("overwrite").save(path)


def read_fits(spark: SparkSession, path: str, region: tuple | slice | None = None) -> tuple[DataFrame, int, int]:
    """(pixels, height, width) of an image or of a region of it, as numpy would cut it (steps are 1), numbered from its own corner."""
    if region is not None and not isinstance(region, (tuple, slice)):
        raise TypeError("a region is a slice or a tuple of slices, such as numpy.s_[1120:1450, 620:950]")
    parts = region if isinstance(region, tuple) else (region,) if region else ()
    if not all(isinstance(p, slice) and p.step in (None, 1) for p in parts):
        raise TypeError("a region has slices without steps")
    text = ",".join(f"{'' if p.start is None else p.start}:{'' if p.stop is None else p.stop}" for p in parts)
    spark.dataSource.register(Fits)
    found = images(path)
    whole = sum(i.height for i in found), found[0].width if found else 0
    top, bottom, left, right = parse_region(text, *whole)
    got = spark.read.format("lacuna_fits").option("region", f"{top}:{bottom},{left}:{right}").load(path)
    iy, ix = (F.col("iy") - top).alias("iy"), (F.col("ix") - left).alias("ix")
    return got.select((iy * (right - left) + ix).alias("node_id"), iy, ix, "v"), bottom - top, right - left
