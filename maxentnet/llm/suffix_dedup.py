"""Removal of passages that earlier documents have: long equal strings by suffix arrays, over places that content alone chooses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.llm import _work, suffix_array
from maxentnet.llm._text import U64, blocks, encoded, from_numbers, gaps, joined, numbers, portions, prefix_hash, release, span_hash, tidy

#: Bytes of a string that counts as a repeat.
WIDTH = 50
#: Bytes of an anchor; every string of WIDTH bytes holds the anchor with the least hash of its 35.
ANCHOR = 16
_SPAN = WIDTH - ANCHOR + 1
_SIDE = _SPAN // 2
#: Bytes of strings that one suffix array covers, about.
_REQUEST = 2 << 20
#: Bytes of text that are hashed at once, and anchors that are packed together, about.
_SLICE = 1 << 20
_PACKED = 1 << 18
#: Bytes of text of a room, which is one table in a task's memory, about.
_ROOM = 128 << 20
_LOW48 = U64((1 << 48) - 1)


class Runs:
    """Runs of windows of a block's texts that share an anchor.

    A window is a string of WIDTH bytes inside a text. Its anchor is the leftmost of the least hashes in it, so that equal windows have
    it at the same place. Run r has the windows that start at ``first[r]`` to ``last[r]``, with the anchor at ``place[r]``; all count
    from the block's begin, ``begins`` has that of each text, ``owner[r]`` is the run's text.
    """

    def __init__(self, texts: list[bytes]):
        self.data, self.begins = joined(texts)
        self.prefix = prefix_hash(self.data)
        count = len(self.data) - ANCHOR + 1
        windows = count - _SPAN + 1
        if windows <= 0:
            self.first = self.last = self.place = self.owner = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, U64)
            return
        at = np.arange(count)
        hashes = span_hash(self.prefix, at, at + ANCHOR)
        least = (hashes & ~U64(0xFFFFFFFF)) | at.astype(U64)
        have = 1
        while have < _SPAN:
            step = min(have, _SPAN - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        place = (least & U64(0xFFFFFFFF)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), np.diff(self.begins))[:windows]
        inside = np.flatnonzero(np.arange(windows) + WIDTH < self.begins[owner + 1])
        place, owner = place[inside], owner[inside]
        edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])))) if len(inside) else np.zeros(0, np.int64)
        self.first = inside[edge]
        self.last = inside[np.append(edge[1:], len(inside)) - 1] if len(edge) else edge
        self.place, self.owner = place[edge], owner[edge]
        self.anchor = hashes[self.place] & _LOW48

    def context(self) -> np.ndarray:
        """48-bit hash of all bytes of each run's windows and of the anchor's place in them."""
        return span_hash(self.prefix, self.first, self.last + WIDTH) + (self.place - self.first).astype(U64) * U64(0x9E3779B97F4A7C15) & _LOW48


def _six(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(data: bytes, at: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8, 6 * n, at).reshape(n, 6)
    return out.view("<u8").reshape(n)


def _split(to: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(bins + 1))


def _room(document: np.ndarray, rooms: int) -> np.ndarray:
    """Where a document's text and what is found for it meet: by Spark's xxhash64 of the key, whatever steps keys come in."""
    p1, p2, p3, p4, p5 = (U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: x << U64(n) | x >> U64(64 - n)
    h = turned(document.astype(np.int64).view(U64) * p2, 31) * p1 ^ (U64(42 + 8) + p5)
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> U64(33)) * p2
    h = (h ^ h >> U64(29)) * p3
    return (h ^ h >> U64(32)).view(np.int64) % rooms


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            for row in batch.slice(at, 64).to_pylist():
                if held and held[0][column] != row[column]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def _anchors(bins: int):
    """Texts -> for each bin the anchors of a slice, packed: gaps of anchors, contexts, documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in portions(batches):
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids, texts = batch.column(0).fill_null(0).to_numpy(), encoded(batch.column(1))
            texts = [x if k else b"" for x, k in zip(texts, known, strict=True)]
            for a, b in blocks(texts, _SLICE):
                runs = Runs(texts[a:b])
                held.append((runs.anchor, runs.context(), ids[a:b][runs.owner]))
                size += len(runs.anchor)
                if size > _PACKED:
                    yield from packed(held)
                    held, size = [], 0
        if size:
            yield from packed(held)

    def packed(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, context, document = (np.concatenate([h[i] for h in held]) for i in range(3))
        to = anchor % U64(bins)
        order = np.argsort(to << U64(48) | anchor) if bins <= 1 << 16 else np.lexsort((anchor, to))
        anchor, context, document = anchor[order], context[order], document[order].astype("<i8")
        edges = np.searchsorted(to[order], np.arange(bins + 1, dtype=U64))
        full = np.flatnonzero(np.diff(edges)).tolist()
        for at in range(0, len(full), 256):
            some = full[at : at + 256]
            data = [numbers(gaps(anchor[edges[k] : edges[k + 1]]), context[edges[k] : edges[k + 1]], document[edges[k] : edges[k + 1]]) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(data, pa.binary())], names=["bin", "data"])

    return run


def _met(rooms: int):
    """A bin's anchors -> (room, kind 0, documents and anchors whose runs an earlier document has whole) and (kind 1, those whose runs must be compared)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bin"):
            anchors, contexts, documents = [], [], []
            for row in rows:
                data, row["data"] = row["data"], None
                anchor, context, document = from_numbers(data, "<u8", "<u8", "<i8")
                anchors.append(np.cumsum(anchor))
                contexts.append(context)
                documents.append(document)
            anchor, context, document = np.concatenate(anchors), np.concatenate(contexts), np.concatenate(documents)
            del anchors, contexts, documents
            order = np.argsort(anchor, kind="stable")
            anchor, context, document = anchor[order], context[order], document[order]
            start = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
            size = np.diff(np.append(start, len(anchor)))
            least, most = np.minimum.reduceat(document, start), np.maximum.reduceat(document, start)
            same = np.minimum.reduceat(context, start) == np.maximum.reduceat(context, start)
            shared, same, least = np.repeat(least < most, size), np.repeat(same, size), np.repeat(least, size)
            for kind, keep in ((0, shared & same & (document > least)), (1, shared & ~same)):
                d, a = document[keep], anchor[keep]
                if not len(d):
                    continue
                order, edges = _split(_room(d, rooms), rooms)
                d, a = d[order], a[order]
                full = np.flatnonzero(np.diff(edges)).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([kind] * len(full), pa.int32()), pa.array([d[edges[k] : edges[k + 1]].astype("<i8").tobytes() + _six(a[edges[k] : edges[k + 1]]) for k in full], pa.binary())], names=["room", "kind", "data"])

    return run


def _ordered(texts: pa.Table) -> tuple[list, list[bytes], list[int]]:
    """A room's rows: key, text, and the number of its text among different ones of the key."""
    ids, data = texts.column("key").to_pylist(), encoded(texts.column("text"))
    of: dict = {}
    for key, text in zip(ids, data, strict=True):
        of.setdefault(key, set()).add(hashlib.sha256(text).digest())
    if all(len(x) == 1 for x in of.values()):
        return ids, data, [0] * len(ids)
    rank = {k: {h: i for i, h in enumerate(sorted(x))} for k, x in of.items()}
    return ids, data, [rank[k][hashlib.sha256(t).digest()] for k, t in zip(ids, data, strict=True)]


_SENT = pa.schema([("bin", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _spans_row(room: int, documents: np.ndarray, numbers: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple:
    return room, 0, documents.astype("<i8").tobytes() + begin.astype("<i8").tobytes() + end.astype("<i8").tobytes() + numbers.astype("<i4").tobytes()


def _sent(bins: int):
    """A room's texts and what was met -> kind 0: spans to remove, for the room; kind 1: strings to compare, for a bin."""

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        pack = zstandard.ZstdCompressor(level=1).compress
        empty = _SENT.empty_table()
        if not texts.num_rows or not found.num_rows:
            return empty
        room = texts.column("room")[0].as_py()
        wanted: list[list] = [[], []]
        for kind, data in zip(found.column("kind").to_pylist(), found.column("data").to_pylist(), strict=True):
            n = len(data) // 14
            # a document and an anchor as one number; what the pair shares with another by chance is compared for nothing
            wanted[kind].append(_pair(np.frombuffer(data, "<i8", n), _from_six(data, 8 * n, n)))
        wanted = [np.unique(np.concatenate(w)) if w else np.zeros(0, U64) for w in wanted]
        ids, data, number = _ordered(texts)
        keep = [i for i, k in enumerate(ids) if k is not None]
        keys, number, data = np.array([ids[i] for i in keep], np.int64), np.array([number[i] for i in keep], np.int32), [data[i] for i in keep]
        _, once = np.unique(np.stack((keys, number.astype(np.int64)), 1), axis=0, return_index=True) if len(keys) else (None, [])
        once = sorted(once)
        keys, number, data = keys[once], number[once], [data[i] for i in once]
        rows: list[tuple] = []
        held: list[tuple] = []
        for a, b in blocks(data, _SLICE):
            runs = Runs(data[a:b])
            if not len(runs.first):
                continue
            document, base = keys[a:b][runs.owner], runs.begins[runs.owner]
            pair = _pair(document, runs.anchor)
            whole = _in(wanted[0], pair)
            if whole.any():
                rows.append(_spans_row(room, document[whole], number[a:b][runs.owner[whole]], (runs.first - base)[whole], (runs.last + WIDTH - base)[whole]))
            mixed = np.flatnonzero(_in(wanted[1], pair))
            if not len(mixed):
                continue
            first, last, place = runs.first[mixed], runs.last[mixed], runs.place[mixed]
            document, base, own = document[mixed], base[mixed], number[a:b][runs.owner[mixed]]
            # windows that begin _SIDE or more before the anchor hold the bytes before it, the others those after it: either
            # makes a longer string that all windows of a group have
            left, right = first <= place - _SIDE, last > place - _SIDE
            begin = np.concatenate((first[left], np.maximum(first, place - _SIDE + 1)[right]))
            end = np.concatenate((np.minimum(last, place - _SIDE)[left], last[right])) + WIDTH
            key = np.concatenate((span_hash(runs.prefix, (place - _SIDE)[left], (place + ANCHOR)[left]), span_hash(runs.prefix, place[right], (place + ANCHOR + _SIDE)[right]) ^ U64(1)))
            document, base, own = (np.concatenate((x[left], x[right])) for x in (document, base, own))
            raw = runs.data.tobytes()
            held.append((key, document.astype("<i8"), (begin - base).astype("<i8"), (end - begin).astype("<i4"), own.astype("<i4"), [raw[x:y] for x, y in zip(begin.tolist(), end.tolist(), strict=True)]))
        if held:
            columns = [np.concatenate([h[i] for h in held]) for i in range(5)]
            strings = [x for h in held for x in h[5]]
            order, edges = _split((columns[0] % U64(bins)).astype(np.int64), bins)
            columns = [c[order] for c in columns]
            for k in np.flatnonzero(np.diff(edges)).tolist():
                x, y = edges[k], edges[k + 1]
                rows.append((k, 1, pack(b"".join([np.array([y - x], "<i8").tobytes(), *(c[x:y].tobytes() for c in columns), *(strings[i] for i in order[x:y].tolist())]))))
        release()
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind.type) for i, kind in enumerate(_SENT)], schema=_SENT) if rows else empty

    return run


def _pair(document: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return anchor.astype(U64) ^ (document.astype(U64) * U64(0xD6E8FEB86659FD93))


def _in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _requests(rooms: int):
    """A bin's strings -> spans (request null) and requests for suffix arrays with the places they are of. Spans on the way pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, "bin"):
            for row in batch:
                if row["kind"] == 0:
                    yield out([(row["bin"], row["data"], None)])
            parts = [zstandard.ZstdDecompressor().decompress(r["data"]) for r in batch if r["kind"] == 1]
            if not parts:
                continue
            columns: list[list] = [[] for _ in range(5)]
            strings: list[bytes] = []
            for data in parts:
                n = int(np.frombuffer(data, "<i8", 1)[0])
                at = 8
                for c, kind in enumerate(("<u8", "<i8", "<i8", "<i4", "<i4")):
                    columns[c].append(np.frombuffer(data, kind, n, at))
                    at += n * int(kind[2])
                ends = at + np.cumsum(columns[3][-1])
                strings += [data[x:y] for x, y in zip((ends - columns[3][-1]).tolist(), ends.tolist(), strict=True)]
            del parts
            key, document, begin, length, number = map(np.concatenate, columns)
            order = np.argsort(key, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
            several = np.minimum.reduceat(document[order], start) < np.maximum.reduceat(document[order], start)
            held = Request()
            whole: list[int] = []
            for a, b in zip(start[several].tolist(), np.append(start[1:], len(order))[several].tolist(), strict=True):
                members = order[a:b].tolist()
                groups: dict[bytes, list[int]] = {}
                for i in members:
                    groups.setdefault(strings[i], []).append(i)
                least = {s: min(int(document[i]) for i in own) for s, own in groups.items()}
                for s, own in groups.items():
                    whole += [i for i in own if document[i] > least[s]]  # an earlier document has the same string
                if len(groups) > 1:
                    held.add(groups, least, document)
                    if held.size > _REQUEST:
                        yield out([(-1, held.places(document, begin, number), held.request())])
                        held = Request()
            if held.strings:
                yield out([(-1, held.places(document, begin, number), held.request())])
            if whole:
                yield spans(document[whole], number[whole], begin[whole], (begin + length)[whole])

    def spans(document: np.ndarray, number: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        order, edges = _split(_room(document, rooms), rooms)
        document, number, begin, end = (x[order] for x in (document, number, begin, end))
        made = [_spans_row(k, *(x[edges[k] : edges[k + 1]] for x in (document, number, begin, end))) for k in np.flatnonzero(np.diff(edges)).tolist()]
        return out([(r, d, None) for r, _, d in made])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["room", "data", "request"])

    return run


class Request:
    """Different strings of some groups; only the first owner of each waits for the answer."""

    def __init__(self) -> None:
        self.strings, self.owners, self.firsts, self.size = [], [], [], 0

    def add(self, groups: dict[bytes, list[int]], least: dict[bytes, int], document: np.ndarray) -> None:
        for s, own in groups.items():
            self.strings.append(s)
            self.owners.append(least[s])
            self.firsts.append([i for i in own if document[i] == least[s]])
            self.size += len(s)

    def request(self) -> bytes:
        return suffix_array.request_repeats(WIDTH, np.array(self.owners, np.int64), self.strings)

    def places(self, document: np.ndarray, begin: np.ndarray, number: np.ndarray) -> bytes:
        lengths = np.array([len(s) for s in self.strings], np.int64)
        index = np.repeat(np.arange(len(self.firsts)), [len(f) for f in self.firsts])
        i = np.concatenate([np.array(f, np.int64) for f in self.firsts])
        starts = np.cumsum(lengths) - lengths
        return b"".join([np.array([len(i)], "<i8").tobytes(), document[i].astype("<i8").tobytes(), begin[i].astype("<i8").tobytes(), starts[index].astype("<i8").tobytes(), lengths[index].astype("<i8").tobytes(), number[i].astype("<i4").tobytes()])


def _answers(rooms: int):
    """Answers of the suffix arrays -> spans for each room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["flags"] is None:
                    yield out([(row["room"], row["data"])])
                    continue
                n = int(np.frombuffer(row["data"], "<i8", 1)[0])
                document, begin, start, length = np.frombuffer(row["data"], "<i8", 4 * n, 8).reshape(4, n)
                number = np.frombuffer(row["data"], "<i4", n, 8 + 32 * n)
                flags = np.frombuffer(row["flags"], np.uint8)
                total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
                hit = np.flatnonzero(total[start + length] > total[start])
                found: list[tuple] = []
                for i in hit.tolist():
                    on = np.flatnonzero(flags[start[i] : start[i] + length[i]])
                    cut = np.flatnonzero(np.diff(on) > 1)
                    for x, y in zip(on[np.append(0, cut + 1)].tolist(), on[np.append(cut, len(on) - 1)].tolist(), strict=True):
                        found.append((document[i], number[i], begin[i] + x, begin[i] + y + WIDTH))
                if found:
                    d, m, b, e = (np.array([f[k] for f in found], np.int64) for k in range(4))
                    order, edges = _split(_room(d, rooms), rooms)
                    yield out([(k, _spans_row(k, *(x[order][edges[k] : edges[k + 1]] for x in (d, m, b, e)))[2]) for k in np.flatnonzero(np.diff(edges)).tolist()])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["room", "data"])

    return run


def _kept(columns: list[tuple[str, pa.DataType]], text_out: bool):
    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, data, number = _ordered(texts)
        spans: dict[tuple, list] = {}
        for x in found.column("data").to_pylist():
            n = len(x) // 28
            document, begin, end = np.frombuffer(x, "<i8", 3 * n).reshape(3, n)
            for d, m, b, e in zip(document.tolist(), np.frombuffer(x, "<i4", n, 24 * n).tolist(), begin.tolist(), end.tolist(), strict=True):
                spans.setdefault((d, m), []).append((b, e))
        removed, runs, digest, left = [], [], [], []
        for key, text, m in zip(ids, data, number, strict=True):
            gone = merged(spans.get((key, m), []))
            rest = text
            if gone:
                edges = [0, *(x for s in gone for x in s), len(text)]
                rest = b"".join([text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)])
            removed.append(len(text) - len(rest))
            runs.append(len(gone))
            if text_out:
                left.append(rest.decode("utf-8", "ignore"))
            else:
                digest.append(hashlib.sha256(rest).hexdigest())
        release()
        last = [pa.array(left, pa.string())] if text_out else [pa.array(digest, pa.string())]
        kept = [texts.column(c).combine_chunks() for c, _ in columns]
        return pa.Table.from_arrays([*kept, pa.array([len(x) for x in data], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), *last], names=[*(c for c, _ in columns), "n_bytes", "n_removed", "n_spans", "kept_text" if text_out else "kept_sha256"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return out


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), text_out: bool = False) -> DataFrame:
    """key, the columns in ``keep``, n_bytes, n_removed, n_spans, and kept_sha256 or (``text_out``) kept_text for every row.

    Each byte goes that lies in a string of WIDTH bytes which also begins in a document with a smaller whole-number key; strings are
    those of the input, and none crosses documents. Bytes are those of UTF-8; kept_text leaves out a character that is cut. A null
    text is an empty one. A null key is neither smaller nor larger: such a row loses nothing and nothing is lost to it. Rows of one
    key don't take from each other; repeated rows get equal results. An empty table gives none; other columns are ignored.

    Runs of windows with one anchor are met by anchor in packed bins. Where all runs of an anchor are equal, later documents lose
    them; the others' strings (the different ones only) meet again by 33 bytes, and a suffix array of each bin's strings, made by
    grouping of Lyndon prefixes, finds which windows a smaller document has. All of it is one plan; texts are shuffled once and read
    twice. Equal runs are told by 48-bit hashes of anchor and bytes: of n runs with one anchor two
    different ones are taken for equal with a chance of n * n / 2 ** 49, which is the only way in which a byte can go that should
    stay; strings that meet by 33 bytes are compared themselves.
    """
    spark = df.sparkSession
    suffix_array.registered(spark)
    bins = _work.parts(spark)
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    rooms = max(_work.parts(spark), -(-size // _ROOM))
    whole = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *keep)
    # nothing is found for null keys: their rows may be in any room
    room = F.pmod(F.xxhash64(F.coalesce("key", F.monotonically_increasing_id())), F.lit(rooms)).cast("long")
    texts = whole.withColumn("room", room).repartition(_work.parts(spark), "room")
    met = _work.by_bin(whole.select("key", "text").mapInArrow(tidy(_anchors(bins)), "bin int, data binary"), "bin").mapInArrow(tidy(_met(rooms)), "room long, kind int, data binary")
    sent = texts.groupBy("room").cogroup(met.groupBy("room")).applyInArrow(_sent(bins), "bin long, kind int, data binary")
    asked = _work.by_bin(sent, "bin", "kind").mapInArrow(tidy(_requests(rooms)), "room long, data binary, request binary")
    # flags are dealt anew (they pack well), so that each stage has one Python worker a core
    flagged = asked.select("room", "data", suffix_array.grouped(spark, F.col("request")).alias("flags")).repartition(_work.parts(spark), "data")
    answered = flagged.mapInArrow(tidy(_answers(rooms)), "room long, data binary")
    columns = [(c, None) for c in ("key", *keep)]
    kept_ddl = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)
    out = texts.groupBy("room").cogroup(answered.groupBy("room")).applyInArrow(_kept(columns, text_out), f"key long, {kept_ddl}n_bytes long, n_removed long, n_spans long, " + ("kept_text string" if text_out else "kept_sha256 string"))
    return out.withColumnRenamed("key", key)
