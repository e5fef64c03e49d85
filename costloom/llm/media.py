"""Media columns: payloads in archives, read back through a Spark data source.

Writing.  Every task packs its rows' payloads as lossless 8-bit greyscale PNG
members into archives (ZIP, members stored as they are) of about
``ARCHIVE_BYTES`` in the shared folder, and returns one manifest row per archive.
Only archives of the manifest count, so what a failed attempt leaves is never read.

Reading.  The data source ``media_archive`` plans byte ranges over the archives'
sizes alone.  A task opens one archive, reads its directory, and takes the members
that start inside its range; payloads leave in Arrow batches of bounded bytes.
Every member is read by its own offset and retried by itself: one that stays
unreadable gives a row with an ``error`` and no payload, and costs no other member.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from costloom.llm.common import map_texts, shared_folder, spread, staged, table, utf8
from costloom.llm.registry import query

WIDTH = 576
PAD = 255
ARCHIVE_BYTES = 64 << 20   # payload bytes after which a task begins a new archive
RANGE_BYTES = 16 << 20     # archive bytes that one reading task takes
BATCH_BYTES = 4 << 20      # payload bytes in one Arrow batch
TRIES = 3
LEVEL = 3                  # of deflate
SIGNATURE = b"\x89PNG\r\n\x1a\n"


# Payloads and their stored form

def payload_of(text: bytes) -> bytes:
    """A text's bytes with bytes 255 appended up to a positive multiple of the width."""
    return text + bytes([PAD]) * (WIDTH - len(text) % WIDTH if len(text) % WIDTH or not text else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, level: int = LEVEL) -> bytes:
    """Greyscale PNG, 8 bits a sample, ``WIDTH`` samples a row, no row filter."""
    rows = len(payload) // WIDTH
    plain = np.zeros((rows, WIDTH + 1), dtype=np.uint8)
    plain[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), level)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> bytes:
    """Samples of a PNG written by ``encode``; every chunk's checksum is tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, width = 8, [], 0
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at:at + 8])
        data = media[at + 8:at + 8 + size]
        if struct.unpack(">I", media[at + 8 + size:at + 12 + size])[0] != zlib.crc32(kind + data):
            raise ValueError("checksum of a chunk")
        if kind == b"IHDR":
            width, rows, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", data)
            if (depth, colour, interlace) != (8, 0, 0):
                raise ValueError("not plain 8-bit grey")
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    plain = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(-1, width + 1)
    if plain[:, 0].any():
        raise ValueError("filtered rows")
    return plain[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean, deviation, entropy of the samples, shares of eight ranges, and a 64-bit row-column difference hash."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    counts = np.bincount(samples, minlength=256)
    share = counts / len(samples)
    level = np.arange(256)
    mean = float((share * level).sum())
    deviation = float(np.sqrt((share * (level - mean) ** 2).sum()))
    held = share[share > 0]
    entropy = float(-(held * np.log2(held)).sum())
    image = samples.reshape(-1, WIDTH).mean(axis=0).reshape(-1, 64).mean(axis=1)  # nine column bands
    bands = np.array([part.mean() for part in np.array_split(samples.astype(np.float64), 8)])
    bits = [int(a < b) for a, b in zip(image, image[1:])] + [int(x > mean) for x in bands]
    ranges = ",".join(f"{x:.4f}" for x in counts.reshape(8, 32).sum(axis=1) / len(samples))
    return f"mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};ranges={ranges};bands={int(''.join(map(str, bits)), 2):04x}"


# Archives

def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Archive:
    """An archive being written, without a seek, to whatever store the path names."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        store, inner = _store(self.path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        self.sink = store.open_output_stream(inner, compression=None)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.members = self.payload = 0

    def add(self, doc_id: int | None, media: bytes, payload: int) -> None:
        name = f"{self.members:08d}_{'null' if doc_id is None else doc_id}.png"
        self.zip.writestr(zipfile.ZipInfo(name), media)
        self.members += 1
        self.payload += payload

    def close(self) -> tuple[str, int]:
        self.zip.close()
        self.sink.close()
        return self.path, self.members


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Packs every text of ``docs`` below ``folder``; ``path``, ``bytes``, ``members`` of each archive.

    A null text counts as empty; a null doc_id stays null.  Rows that repeat stay members of their own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                if archive is None:
                    archive = _Archive(folder)
                payload = payload_of(text)
                archive.add(doc_id, encode(payload), len(payload))
                if archive.payload >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        sizes = []
        for path, _ in done:
            store, inner = _store(path)
            sizes.append(store.get_file_info(inner).size)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array(sizes, pa.int64()),
                                          pa.array([x[1] for x in done], pa.int64())], names=["path", "bytes", "members"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged(map_texts(spread(plain), run, "path string, bytes long, members long"))


class Range(InputPartition):
    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class MediaArchive(DataSource):
    """``media_archive``: option ``archives`` lists path and size of each archive, one a line."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, archive string, offset long, media binary, payload binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.archives = [(p, int(n)) for n, _, p in (x.partition(" ") for x in options.get("archives", "").split("\n") if x)]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def partitions(self) -> list[InputPartition]:
        out = [Range(path, low, min(low + self.range_bytes, size)) for path, size in self.archives for low in range(0, size, self.range_bytes)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for info in members(partition.path, partition.low, partition.high) if partition.path else ():
            media, payload, error = read_member(partition.path, info, self.tries)
            doc_id = info.filename.partition("_")[2].removesuffix(".png")
            rows.append((None if doc_id == "null" else int(doc_id), partition.path, info.header_offset, media, payload, error))
            held += len(payload or b"")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      names=["doc_id", "archive", "offset", "media", "payload", "error"])


def members(path: str, low: int, high: int) -> list[zipfile.ZipInfo]:
    """Members that start in bytes ``low`` to ``high`` of an archive, by its directory."""
    store, inner = _store(path)
    with store.open_input_file(inner) as source, zipfile.ZipFile(source) as archive:
        return [x for x in archive.infolist() if low <= x.header_offset < high]


def read_member(path: str, info: zipfile.ZipInfo, tries: int = TRIES) -> tuple[bytes | None, bytes | None, str | None]:
    """Stored form, payload and error of one member, tried again from its own offset."""
    error = None
    for attempt in range(max(1, tries)):
        try:
            store, inner = _store(path)
            with store.open_input_file(inner) as source:
                source.seek(info.header_offset)
                head = source.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise ValueError("no member at this offset")
                name, extra = struct.unpack("<HH", head[26:30])
                source.seek(info.header_offset + 30 + name + extra)
                media = source.read(info.file_size)
            if zlib.crc32(media) != info.CRC:
                raise ValueError("checksum of a member")
            return media, decode(media), None
        except Exception as e:  # whatever the store or the bytes give: the next try starts anew
            error = f"{type(e).__name__}: {e}"[:200]
            time.sleep(min(2.0, 0.05 * 2 ** attempt) if attempt + 1 < tries else 0)
    return None, None, error


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All members of the archives of ``manifest``: ``doc_id``, ``archive``, ``offset``, ``media``, ``payload``, ``error``.

    The manifest has one row for each ``ARCHIVE_BYTES`` of payloads, so its list is small.
    """
    spark.dataSource.register(MediaArchive)
    listed = "\n".join(f"{r.bytes} {r.path}" for r in manifest.orderBy("path").select("bytes", "path").collect())
    return spark.read.format("media_archive").option("archives", listed).option("range_bytes", str(range_bytes)).load()


def media_columns(read: DataFrame) -> DataFrame:
    """Columns computed from members read back; a member with an error has null in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, payload = batch.column(1).to_pylist(), batch.column(2).to_pylist()

            def each(values, fn, kind):
                return pa.array([None if x is None else fn(x) for x in values], kind)

            yield pa.RecordBatch.from_arrays([
                batch.column(0), each(payload, lambda x: len(x.rstrip(bytes([PAD]))), pa.int64()), each(payload, len, pa.int64()),
                each(payload, lambda x: hashlib.sha256(x).hexdigest(), pa.string()), each(payload, lambda x: zlib.crc32(x[-32:]), pa.int64()),
                each(media, len, pa.int64()), each(media, lambda x: hashlib.sha256(x).hexdigest(), pa.string()),
                each(payload, feature_of, pa.string()), batch.column(3)],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    return map_texts(read.select("doc_id", "media", "payload", "error"), run,
                     "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


@query("op9_media_columns")
def op9_media_columns(spark, sf_dir):
    """Every text stored as a PNG in archives, read back by byte ranges, and described."""
    folder = shared_folder(spark)
    manifest = write_archives(table(spark, sf_dir, "documents"), folder)
    return media_columns(read_archives(spark, manifest))
