"""Media columns: payloads by content address in tar shards; rows hold digest, offset and length; headers alone fill the metadata."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.llm import _work
from maxentnet.llm._text import encoded

WIDTH = 64
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes that hold the signature and the whole header chunk.
HEADER_BYTES = 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey picture, 64 samples a row, each sample a byte of the payload (a positive multiple of 64)."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    return _SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER_BYTES bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the header of a picture")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The payload; every chunk's checksum is held against its bytes."""
    width, height, _ = png_header(data[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(data[at + 4 : at + 8 + size]) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if data[at + 4 : at + 8] == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected filter")
    return np.ascontiguousarray(lines[:, 1:]).tobytes()


def feature(payload: bytes) -> str:
    """Mean sample, and a 64-bit average hash: which of 64 equal strips are brighter than the mean."""
    strips = np.array([x.mean() if len(x) else 0.0 for x in np.array_split(np.frombuffer(payload, np.uint8).astype(np.float64), 64)])
    mean = float(np.frombuffer(payload, np.uint8).mean())
    bits = int("".join("1" if x else "0" for x in strips > mean), 2)
    return f"{mean:.3f}:{bits:016x}"


class _Shards:
    """Tar files of one task; a name is never used twice, so a repeated task leaves the first one's files alone."""

    def __init__(self, base: str):
        self.store, self.path = fs.FileSystem.from_uri(base)
        self.out = None

    def put(self, digest: str, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.store.create_dir(self.path, recursive=True)
            self.out, self.at, self.held = self.store.open_output_stream(f"{self.path}/{self.name}"), 0, {}
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.GNU_FORMAT)
            self.out.write(head + data + b"\0" * (-len(data) % 512))
            self.held[digest] = (self.name, self.at + len(head), len(data))
            self.at += len(head) + len(data) + (-len(data) % 512)
        place = self.held[digest]
        if self.at >= SHARD_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def padded(text: bytes) -> bytes:
    return text + b"\0" * (WIDTH if not text else -len(text) % WIDTH)


def store(df: DataFrame, base: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the payload of every row to tar shards under the URI ``base`` (any store that pyarrow opens); gives key, n_bytes, digest, shard, offset, length.

    A shard holds a digest once. The frame writes whenever it runs, so keep it in a table before using it twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(base)
        for batch in batches:
            sizes, digests, places = [], [], []
            for x in encoded(batch.column(1)):
                payload = padded(x)
                digest = hashlib.sha256(payload).hexdigest()
                sizes.append(len(x))
                digests.append(digest)
                held = shards.held.get(digest) if shards.out is not None else None
                places.append(held or shards.put(digest, to_png(payload)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), *(pa.array([p[i] for p in places], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64())))],
                names=[key, "n_bytes", "digest", "shard", "offset", "length"],
            )
        shards.close()

    source = df.select(key, text)
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, n_bytes long, digest string, shard string, offset long, length long")


def metadata(places: DataFrame, base: str) -> DataFrame:
    """Adds width, height and bits to rows of (digest, shard, offset, length): of each payload only the header's bytes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in _opened(batches, base):
            heads = []
            for x in batch.to_pylist():
                files[x["shard"]].seek(x["offset"])
                heads.append(png_header(files[x["shard"]].read(HEADER_BYTES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([h[i] for h in heads], pa.int64()) for i in range(3))], names=[*batch.schema.names, "width", "height", "bits"])

    return places.mapInArrow(run, f"{_ddl(places)}, width long, height long, bits long")


def read(places: DataFrame, base: str) -> DataFrame:
    """Adds what the stored bytes say: payload_bytes (from the header), payload_sha256, tail_crc32, media_sha256, feature. A digest that the bytes contradict is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, files in _opened(batches, base):
            out = []
            for x in batch.to_pylist():
                files[x["shard"]].seek(x["offset"])
                data = files[x["shard"]].read(x["length"])
                width, height, _ = png_header(data[:HEADER_BYTES])
                payload = from_png(data)
                digest = hashlib.sha256(payload).hexdigest()
                if len(payload) != width * height or digest != x["digest"]:
                    raise ValueError(f"the payload at {x['shard']}:{x['offset']} is not {x['digest']}")
                out.append((width * height, digest, zlib.crc32(payload[-WIDTH:]), hashlib.sha256(data).hexdigest(), feature(payload)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds))], names=[*batch.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "media_sha256", "feature"])

    return places.mapInArrow(run, f"{_ddl(places)}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)


class _Files(dict):
    def __init__(self, base: str):
        self.store, self.path = fs.FileSystem.from_uri(base)

    def __missing__(self, shard: str):
        for x in self.values():  # rows come shard by shard: one file is open at a time
            x.close()
        self.clear()
        self[shard] = self.store.open_input_file(f"{self.path}/{shard}")
        return self[shard]


def _opened(batches: Iterator[pa.RecordBatch], base: str) -> Iterator[tuple[pa.RecordBatch, _Files]]:
    files = _Files(base)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256), files


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text", base: str | None = None) -> DataFrame:
    """Stores every text and reads it back: key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, shard, offset, length, width, height.

    A payload is the text's UTF-8 (a null is empty) with zero bytes up to a positive multiple of 64, stored as a grey picture of
    64 samples a row. Equal payloads share one place, the least of those written. One row per input row, null keys and repeated
    rows included; an empty table gives none; other columns are ignored. Texts are never moved: tasks write what they read, and
    only digests and places are shuffled (copies are combined before that).
    """
    base = base or _work.folder(df.sparkSession, "media")
    rows = _work.written(store(df, base, key, text), "media-rows")
    places = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    places = places.repartition(_work.parts(df.sparkSession), "shard").sortWithinPartitions("shard", "offset")
    stored = _work.written(read(metadata(places, base), base).withColumnRenamed("length", "media_bytes"), "media-read")
    return rows.select(key, "n_bytes", "digest").join(stored, "digest").select(key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "width", "height")
