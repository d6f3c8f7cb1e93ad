"""Packing token sequences into windows: best-fit decreasing with a segment tree over remaining capacity."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.llm import _work
from maxentnet.llm._text import tidy

WINDOW = 1024
END = 0
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that one task packs at once, about.
GROUP_PIECES = 50_000
_coders: dict = {}


def byte_characters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a character: printable Latin-1 as itself, the rest from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def coder(path: str):
    """The byte-level BPE of a tokenizers file. Its merges stand in order of their ids, so that ids serve as ranks and the faster tiktoken gives the same ids."""
    if path not in _coders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added, before = spec.get("added_tokens", []), spec.get("pre_tokenizer") or {}
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec.get("normalizer") or any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError(f"{path} is not a byte-level vocabulary that cuts texts by PATTERN and at its added tokens only")
        special = {x["content"]: x["id"] for x in added}
        to_byte = byte_characters()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        _coders[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _coders[path]


class Capacity:
    """Segment tree over 0..size: how many open windows have each remaining capacity; finds the least capacity that holds a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i = capacity + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Removes and gives (capacity, window) of the tightest window that has room for ``length``."""
        i, count = length + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        window = self.open[capacity].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, window


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece (1 to ``window`` long): the longest first, each into the tightest window that holds it."""
    tree, windows = Capacity(window), 0
    at, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        found = tree.take(size)
        if found is None:
            found, windows = (window, windows), windows + 1
        room, w = found
        at[i], offset[i] = w, window - room
        if room > size:
            tree.add(room - size, w)
    return at, offset


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, ids: bool = False) -> DataFrame:
    """Tokenizes whole texts, appends END, cuts full windows: key, start, length, ids_crc32, doc_tokens and, if asked, the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                row, start, length, crc, total, held = [], [], [], [], [], []
                for i, x in enumerate(part.column(1).to_pylist()):
                    tokens = np.array([*encode(x or "", allowed_special="all"), END], "<u4")
                    for s in range(0, len(tokens), window):
                        piece = tokens[s : s + window]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(tokens))
                        if ids:
                            held.append(piece.astype(np.int32))
                columns = [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(held, pa.list_(pa.int32()))] if ids else [])], names=[key, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if ids else [])])

    source = df.select(key, text)
    return source.mapInArrow(tidy(run), f"`{key}` {source.schema[key].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if ids else ""))


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, ids: bool = False) -> DataFrame:
    """Every token of every text in exactly one piece, every piece at a place in a window: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A text longer than a window is cut into full windows first; the rest of it is packed by best-fit decreasing. A null text is
    empty: its END alone is packed. Null keys and repeated rows are documents like others; an empty table gives no piece; other
    columns are ignored. Pieces are dealt by hash (of their place in the table too, so that equal rows are spread) to groups of about
    GROUP_PIECES, and each group is packed by itself: a group leaves few windows unfilled, as it has pieces of every length. The groups grow in number with the input, not in size.
    """
    spark = df.sparkSession
    cut = _work.written(pieces(df, path, key, text, window, ids), "pieces")
    groups = max(1, -(-cut.count() // GROUP_PIECES))
    cut = cut.withColumn("group", F.pmod(F.xxhash64(key, "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    cut = cut.repartition(min(groups, _work.parts(spark) * 4), "group").sortWithinPartitions("group", key, "start", "ids_crc32")
    kind = cut.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            at, offset = best_fit(table.column("length").to_numpy(), window)
            table = table.append_column("sequence_id", pa.array(at + (table.column("group")[0].as_py() << 32))).append_column("offset", pa.array(offset))
            yield from table.drop_columns(["group"]).combine_chunks().to_batches()

        for batch in batches:
            group = batch.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column("group")[0].as_py() != group[a]:
                    yield from packed()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from packed()

    ddl = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kind if x.name != "group")
    return cut.mapInArrow(tidy(run), f"{ddl}, sequence_id long, offset long")
