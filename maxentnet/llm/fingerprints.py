"""Document fingerprints by locally consistent parsing: deterministic coin tossing cuts a text into phrases, again and again; equal substrings get equal interior phrases wherever they stand."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from maxentnet.llm import _work
from maxentnet.llm._text import U64, mix, powers, tidy

#: Names kept in a fingerprint unless told otherwise: the least ones, a sample of all that is the same for equal phrases. A likeness of
#: two samples is off from that of all names by sqrt(x (1 - x) / SAMPLE) in the mean of squares, 0.0625 at most.
SAMPLE = 64
#: The lowest level whose names count; its phrases are about 10 characters long, those of each level above 3 times as long.
LOWEST = 2
_RUN = mix(np.array([1], U64))[0]


def _level(level: int) -> np.uint64:
    return mix(np.array([level + 1], U64))[0]


def _lowest(x: np.ndarray) -> np.ndarray:
    """Index of the lowest set bit; 0 for 0."""
    low = x & (~x + U64(1))
    return np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(U64)


def parse(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of each sequence (``first`` marks where one begins), and where a sequence begins among them.

    Repeats of a name become one block, named by it and its length. Neighbours then differ, and three rounds of coin tossing
    (twice the lowest bit in which a label differs from the one before, plus that bit) leave labels below 8 that still differ; a
    phrase begins at each label larger than both neighbours (beyond a sequence's ends there are smaller ones), but for the second
    label of a sequence: phrases have two labels at least, the last one aside, so that each level halves a sequence.
    """
    head = np.empty(len(names), bool)
    head[0] = True
    head[1:] = names[1:] != names[:-1]
    head |= first
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, len(names)))
    names, first = names[at], first[at]
    names = np.where(runs > 1, mix(names + _RUN * runs.astype(U64)), names)
    label = names
    for _ in range(3):
        differ = np.empty_like(label)
        differ[0] = 1
        differ[1:] = label[1:] ^ label[:-1]
        bit = _lowest(differ)
        bit[first] = 0
        label = U64(2) * bit + ((label >> bit) & U64(1))
    label = label.astype(np.int64)
    none = np.full(1, -1)
    after = np.where(np.append(first[1:], True), -1, np.concatenate((label[1:], none)))
    begins = (label > np.concatenate((none, label[:-1]))) & (label > after)
    begins[1:] &= ~first[:-1]
    begins |= first
    start = np.flatnonzero(begins)
    power, inverse = powers(len(names) + 1)
    total = np.zeros(len(names) + 1, U64)
    np.cumsum(names * power[: len(names)], out=total[1:])
    end = np.append(start[1:], len(names))
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64)), first[start]


def fingerprints(texts: list[str], sample: int | None = SAMPLE) -> list[np.ndarray]:
    """Sorted names of each text's phrases, from level LOWEST up to the one phrase that is the whole text; the least ``sample`` (None: all). An empty text has none. Each text's are its own, whatever stands beside it."""
    out: list[np.ndarray] = []
    begin = size = 0
    for i, x in enumerate([*texts, None]):
        if x is None or size and size + len(x) > 1 << 20:
            out += _block(texts[begin:i], sample)
            begin, size = i, 0
        size += len(x or "")
    return out


def _block(texts: list[str], sample: int | None) -> list[np.ndarray]:
    out = [np.zeros(0, U64)] * len(texts)
    owner = np.array([i for i, x in enumerate(texts) if x], np.int64)
    if not len(owner):
        return out
    sizes = np.array([len(texts[i]) for i in owner])
    names = mix(np.frombuffer("".join(texts[i] for i in owner).encode("utf-32-le", "surrogatepass"), "<u4").astype(U64) + U64(1))
    first = np.zeros(len(names), bool)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    taken, of, level = [], [], 0
    while len(names):
        level += 1
        names, first = parse(names, first)
        counts = np.diff(np.append(np.flatnonzero(first), len(names)))
        if level < LOWEST:
            continue
        taken.append(mix(names + _level(level)))
        of.append(np.repeat(owner, counts))
        going = counts > 1
        go = np.repeat(going, counts)
        names, first, owner = names[go], first[go], owner[going]
    names, of = np.concatenate(taken), np.concatenate(of)
    order = np.lexsort((names, of))
    names, of = names[order], of[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (of[1:] != of[:-1])
    names, of = names[new], of[new]
    at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    for a, b in zip(at, np.append(at[1:], len(of)), strict=True):
        out[of[a]] = names[a : b if sample is None else min(b, a + sample)]
    return out


def likeness(a: np.ndarray, b: np.ndarray, sample: int | None = SAMPLE) -> float:
    """Share of common names among the least ``sample`` of both (None: of all): about, or exactly, that of all their names. Two without names are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:sample]
    return float((np.intersect1d(a, b, assume_unique=True) <= both[-1]).sum() / len(both))


def text_of(names: np.ndarray) -> str:
    return names.astype(">u8").tobytes().hex()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int | None = SAMPLE) -> DataFrame:
    """key and the fingerprint of each text, in no shuffle; a null text is an empty one, repeated rows give repeated results, keys are of any kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints([x or "" for x in batch.column(1).to_pylist()], sample)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(text_of, found), pa.string())], names=[key, "fingerprint"])

    source = df.select(key, text)
    return source.mapInArrow(run, f"`{key}` {source.schema[key].dataType.simpleString()}, fingerprint string")


def _ranges(rows: DataFrame, count: int):
    """A Column function of (k, h): the range of a row in the order of k from the largest on, null ones last and by h; and the range that needs the row as its end, if any.

    The cuts are numbers that the driver holds, a few for each of ``count`` ranges. Equal keys are in one range, null ones in as
    many as their number asks for.
    """
    cuts = rows.select("k").approxQuantile("k", [i / count for i in range(1, count)], 1 / (4 * count)) if count > 1 else []
    cuts = np.array(sorted({int(x) for x in cuts}), np.int64)
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("k").isNull())).first()
    parts = -(-nulls * count // max(n, 1))  # of the null keys, whose hashes are spread evenly

    def place(k: pa.Array, h: np.ndarray) -> np.ndarray:
        empty = k.is_null().to_numpy(zero_copy_only=False)
        known = k.fill_null(0).to_numpy()
        high = ((h >> 32) + (1 << 31)) * parts >> 32  # h from its least value on, as one of ``parts``
        return np.where(empty, len(cuts) + 1 + high, len(cuts) - np.searchsorted(cuts, known, side="right"))

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(batch.column(0), batch.column(1).to_numpy()).astype(np.int32)), batch.column(0), batch.column(1)], names=["part", "k", "h"])

    # whole texts are read for null keys only
    keys = rows.filter("k IS NOT NULL").select("k", F.lit(0).cast("long").alias("h")).unionByName(rows.filter("k IS NULL").select("k", "h"))
    tops = keys.mapInArrow(first_of, "part int, k long, h long").groupBy("part").agg(F.max("k").alias("k"), F.min("h").alias("h")).collect()  # a row for each range
    tops = {r["part"]: (r["k"], r["h"]) for r in tops}
    filled = sorted(tops)
    before = np.zeros(max(filled, default=0) + 1, np.int32)
    top = np.zeros(len(before), np.int64)
    for i, p in enumerate(filled):
        before[p], top[p] = filled[i - 1], tops[p][1] if tops[p][0] is None else tops[p][0]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h = batch.column(0), batch.column(1).to_numpy()
            part = place(k, h)
            leads = np.where(k.is_null().to_numpy(zero_copy_only=False), h, k.fill_null(0).to_numpy()) == top[part]
            again = pa.array(np.flatnonzero(leads))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array(np.zeros(len(part), np.int32))], names=["k", "h", "t", "part", "ahead"])
            yield pa.RecordBatch.from_arrays([*(c.take(again) for c in batch.columns), pa.array(before[part[leads]]), pa.array(np.ones(len(again), np.int32))], names=["k", "h", "t", "part", "ahead"])

    return rows.select("k", "h", "t").mapInArrow(dealt, "k long, h long, t string, part int, ahead int")


def against_next(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int | None = SAMPLE) -> DataFrame:
    """Each text against its edited form and against the next document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller key (equal keys by text; null keys last, by a hash of the text, then the text; after
    the last the first). Keys are whole numbers; others raise a TypeError. A null text is an empty one; an empty table gives none; other columns
    are ignored. Rows are dealt by ranges of the key, each with a copy of the row that begins the next range, and read in order.
    """
    kind = df.schema[key].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"The column {key} must hold whole numbers, not {kind.simpleString()}.")
    spark = df.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).cast("long").alias("k"), F.when(F.col(key).isNull(), F.xxhash64(t)).otherwise(0).alias("h"), t.alias("t"))
    count = _work.parts(spark)
    dealt = _ranges(rows, count).repartition(count, "part").sortWithinPartitions("part", "ahead", F.col("k").desc_nulls_last(), "h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range, in order; the last one waits for its next
        size, now, over = 0, None, False

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            todo = held[:-1]
            if not todo:
                held = [] if last else held
                return
            texts = [t for _, t in held]
            other = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            mine, theirs = fingerprints(texts, sample), fingerprints(other, sample)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in todo], pa.int64()),
                    pa.array(list(map(len, texts[:-1])), pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in other], pa.string()),
                    pa.array(list(map(text_of, mine[:-1])), pa.string()),
                    pa.array(list(map(text_of, theirs)), pa.string()),
                    pa.array([likeness(a, b, sample) for a, b in zip(mine, theirs, strict=False)], pa.float64()),
                    pa.array([likeness(a, b, sample) for a, b in zip(mine, mine[1:], strict=False)], pa.float64()),
                ],
                names=["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            held = [] if last else held[-1:]
            size = 0

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                for row in batch.slice(begin, 256).to_pylist():
                    if row["part"] != now:
                        held, size, now, over = [], 0, row["part"], False
                    if over:
                        continue  # a further row ahead with the same key
                    held.append((row["k"], row["t"]))
                    size += len(row["t"])
                    over = row["ahead"] == 1
                    if over or size > 1 << 20:
                        yield from flush(over)

    dealt = dealt.select("k", "t", "part", "ahead")
    out = dealt.mapInArrow(tidy(run), "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.select(F.col("k").cast(kind).alias(key), *out.columns[1:])
