"""Web archives: one Zstandard frame a record after a skippable frame with the dictionary; a reader that checks headers and lengths."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.llm import _work
from maxentnet.llm._text import encoded

#: Magic number of the skippable frame that carries a dictionary in .warc.zst files.
DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 256 << 20
#: A file's dictionary is fitted on its first pages, up to so many bytes of them.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_WHEN = "2000-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def page_of(urn: str) -> int | None:
    if not urn.startswith("<urn:page:") or urn.count(":") != 3:
        raise ValueError(f"unknown record id {urn}")
    page = urn.split(":")[2]
    return int(page) if page else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A whole record; a response holds the payload, a revisit (``first`` is the page it repeats) only its HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    kind = "response" if first is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page, digest)}",
        f"WARC-Date: {_WHEN}",
        "WARC-Target-URI: " + "".join(c for c in url or "" if c not in "\r\n"),
        "Content-Type: application/http;msgtype=response",
        f"WARC-Block-Digest: sha1:{payload_digest(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(first, digest)}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.decode("utf-8", "surrogateescape").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip() or name.lower() in out:
            raise ValueError(f"bad header line {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def parse(data: bytes) -> dict:
    """One record of a frame, checked: version, headers, lengths, digests."""
    version, _, rest = data.partition(b"\r\n")
    top, blank, rest = rest.partition(b"\r\n\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not blank:
        raise ValueError("no record begins here")
    head = headers(top)
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - head.keys():
        raise ValueError(f"a record lacks {sorted(missing)}")
    if not head["content-length"].isdigit() or len(rest) != int(head["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    block = rest[:-4]
    if head.get("warc-block-digest", "sha1:" + (d := payload_digest(block))) != "sha1:" + payload_digest(block):
        raise ValueError("a block's digest is wrong")
    status, _, after = block.partition(b"\r\n")
    fields, _, payload = after.partition(b"\r\n\r\n")
    size = int(headers(fields)["content-length"])
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a payload's length or digest is wrong")
    if kind == "revisit" and (payload or head.get("warc-profile") != REVISIT):
        raise ValueError("a revisit must be without payload")
    return {"page": page_of(head["warc-record-id"]), "url": head.get("warc-target-uri", ""), "bytes": size, "digest": digest, "kind": kind, "refers_to": page_of(head["warc-refers-to"]) if kind == "revisit" else None, "payload": payload}


def dictionary(samples: list[bytes]) -> bytes:
    """Fitted on the samples; where these are too few for that, their own first bytes serve."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


class Writer:
    def __init__(self, out, samples: list[bytes]):
        self.out, held = out, dictionary(samples)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
        self.at = 8 + len(held)
        self.pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(held) if held else None, write_checksum=True, write_content_size=True)

    def put(self, data: bytes) -> None:
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.at += len(frame)


def read_frames(stream, at_once: int = 1 << 20) -> Iterator[bytes]:
    """The record of each frame of an open archive, in bounded memory: one frame and a buffer."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary leads the archive")
    held = stream.read(size)
    if len(held) != size:
        raise ValueError("the dictionary is cut off")
    if held[:4] == b"\x28\xb5\x2f\xfd":  # itself a frame
        held = zstandard.ZstdDecompressor().decompress(held)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    rest, ended = b"", False
    while rest or not ended:
        if not rest:
            rest = stream.read(at_once)
            ended = not rest
            continue
        one, out = unpack.decompressobj(), []
        while True:
            out.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(at_once)
            if not rest:
                raise ValueError("the last frame is cut off")
        yield b"".join(out)


def write(df: DataFrame, base: str, key: str = "page_id", text: str = "html", url: str = "url", least: int = 0) -> DataFrame:
    """Writes an archive or more for each task under the URI ``base``; gives the archives' names and record counts. Runs again whenever the frame does: keep it in a table.

    Of equal payloads of ``least`` bytes or more the one with the smallest key is a response and others revisit it.
    """
    source = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(url).cast("string").alias("u"))
    light = source.select("k", F.sha1("t").alias("h"), F.octet_length("t").alias("n")).filter((F.col("n") >= least) & F.col("k").isNotNull())
    firsts = light.groupBy("h").agg(F.min("k").alias("first"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    # rows (one for each page and payload, few) that repeat an earlier page
    again = light.join(firsts, "h").filter("k > first").select(F.col("k").alias("rk"), F.col("h").alias("rh"), "first").distinct()
    marked = source.withColumn("h", F.sha1("t")).join(again, (F.col("k") == F.col("rk")) & (F.col("h") == F.col("rh")), "left").select("k", "u", "t", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(base)
        store.create_dir(path, recursive=True)
        writer, name, count, names = None, "", 0, []

        def close():
            if writer is not None:
                writer.out.close()
                names.append((name, count))

        for batch in batches:
            pages, payloads = batch.column(0).to_pylist(), encoded(batch.column(2))
            for page, address, payload, first in zip(pages, batch.column(1).to_pylist(), payloads, batch.column(3).to_pylist(), strict=True):
                if writer is None or writer.at >= ARCHIVE_BYTES:
                    close()
                    samples, size = [], 0
                    for x in payloads:
                        if size >= SAMPLE_BYTES:
                            break
                        samples.append(x[: SAMPLE_BYTES - size])
                        size += len(samples[-1])
                    name, count = f"{uuid.uuid4().hex}.warc.zst", 0
                    writer = Writer(store.open_output_stream(f"{path}/{name}"), samples)
                writer.put(record(page, address, payload, payload_digest(payload), first))
                count += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.int64())], names=["archive", "records"])

    return marked.mapInArrow(run, "archive string, records long")


def read(archives: DataFrame, base: str, payload: bool = False) -> DataFrame:
    """Rows of (archive, records) to a row for each record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(base)
        for batch in batches:
            for name, records in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, rows, held = 0, [], 0
                with store.open_input_stream(f"{path}/{name}") as stream:
                    for data in read_frames(stream):
                        rows.append(parse(data))
                        seen += 1
                        held += len(data) if payload else 200
                        if held > 1 << 23:
                            yield made(rows)
                            rows, held = [], 0
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, not {records}")
                yield made(rows)

    def made(rows: list[dict]) -> pa.RecordBatch:
        columns = [("page_id", "page", pa.int64()), ("url", "url", pa.string()), ("payload_bytes", "bytes", pa.int64()), ("payload_digest", "digest", pa.string()), ("record_type", "kind", pa.string()), ("refers_to", "refers_to", pa.int64()), *([("payload", "payload", pa.binary())] if payload else [])]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for _, k, kind in columns], names=[c for c, _, _ in columns])

    archives = archives.repartition(_work.parts(archives.sparkSession), "archive")
    return archives.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payload else ""))


def round_trip(df: DataFrame, key: str = "page_id", text: str = "html", url: str = "url", least: int = 0, base: str | None = None) -> DataFrame:
    """Writes archives of all rows and reads them back: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    One record per row: a null text is an empty payload, a null url an empty one (line breaks in urls go). Rows with a null key are
    responses and nothing refers to them; repeated rows of the smallest key are responses all. An empty table gives no record; other
    columns are ignored. Keys are whole numbers.
    """
    base = base or _work.folder(df.sparkSession, "warc")
    return read(_work.written(write(df, base, key, text, url, least), "warc-names"), base)


#: The same rows in DuckDB's SQL, of a table whose keys are distinct and not null.
ROUND_TRIP_SQL = r"""
WITH p AS (SELECT page_id, replace(replace(coalesce(url, ''), chr(13), ''), chr(10), '') AS url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
SELECT page_id, url, strlen(body)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, ((i // 4) * 5 + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to FROM p
"""
