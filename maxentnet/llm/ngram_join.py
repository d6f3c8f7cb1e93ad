"""N-gram Jaccard self-join over prefix trees: exact links of 5-word shingle sets, and the components that they make."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.llm import _work
from maxentnet.llm._text import U64, distinct, encoded, from_numbers, gaps, mix, numbers, portions, shingle_sets, tidy
from maxentnet.llm.components import Forest, components

WORDS = 5
#: Linked when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Distinct sets that one task holds in a tree, about; a larger group of candidates is dealt out as pairs of blocks.
BLOCK = 1024
#: Rows of a slice, so that a place in it takes two bytes.
_SLICE = 1 << 15


def needed(size: int | np.ndarray) -> int | np.ndarray:
    """Least overlap of a set of ``size`` with any that it links with."""
    return -(-size * PERCENT // 100)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Keys and shingle sets of some thousand rows."""
    keys, sets, size = [], [], 0
    for batch in portions(batches):
        texts = encoded(batch.column(1))
        for key, own in zip(batch.column(0).to_pylist(), shingle_sets(texts, WORDS), strict=True):
            keys.append(key)
            sets.append(own)
            size += len(own)
            if size > 1 << 19 or len(keys) >= _SLICE:
                yield keys, sets
                keys, sets, size = [], [], 0
    if keys:
        yield keys, sets


def signature(own: np.ndarray) -> int:
    """64-bit hash of a whole set; 0 only for the empty set."""
    if not len(own):
        return 0
    total = int(mix(np.array([own.sum(dtype=U64) ^ mix(own).sum(dtype=U64) + U64(len(own))], U64))[0])
    return (total or 1) - (1 << 64) * (total >= 1 << 63)


def _dealt(df: DataFrame, key: str, text: str, bins: int) -> DataFrame:
    """Rows (bin, slice, data) of kind 1, a bin's shingles of the distinct sets of a slice with their places in its table, and of kind 0, the slice's table of sets and documents.

    Slices are named by partition and number, so that a repeated task makes the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (keys, sets) in enumerate(_slices(batches)):
            name = task << 32 | number
            marks = [signature(x) for x in sets]
            chosen = sorted({m: i for i, m in reversed(list(enumerate(marks))) if m}.values())  # equal sets of a slice are one
            counts = np.array([len(sets[i]) for i in chosen], np.int64)
            table = pickle.dumps((np.array([marks[i] for i in chosen], np.int64), counts, keys, np.array(marks, np.int64), np.array([len(x) for x in sets], np.int64)), protocol=5)
            yield made([(name % bins, name, 0, table)])
            if not chosen:
                continue
            shingles = np.concatenate([sets[i] for i in chosen])
            owner = np.repeat(np.arange(len(chosen)), counts)
            order = np.argsort(shingles)
            shingles, owner = shingles[order], owner[order].astype("<u2")
            edges = np.searchsorted(((shingles >> U64(40)) * U64(bins) >> U64(24)).astype(np.int64), np.arange(bins + 1))
            full = np.flatnonzero(np.diff(edges)).tolist()
            for at in range(0, len(full), 256):
                yield made([(b, name, 1, numbers(gaps(shingles[edges[b] : edges[b + 1]]), owner[edges[b] : edges[b + 1]])) for b in full[at : at + 256]])

    return df.select(F.col(key).cast("long").alias("key"), text).mapInArrow(tidy(run), "bin int, slice long, kind int, data binary")


def made(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bin", "slice", "kind", "data"])


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows of one value of ``column`` after another (the rows come in its order)."""
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


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bin's shingles of all slices -> for each slice those that another set has too, with the number of sets. Tables pass."""
    for rows in _grouped(batches, "bin"):
        for row in rows:
            if row["kind"] == 0:
                yield made([(row["bin"], row["slice"], 0, row["data"])])
        rows = [r for r in rows if r["kind"] == 1]
        if not rows:
            continue
        shingles, owners, of = [], [], []
        for i, row in enumerate(rows):
            shingle, owner = from_numbers(row["data"], "<u8", "<u2")
            shingles.append(np.cumsum(shingle))
            owners.append(owner)
            of.append(np.full(len(owner), i, np.int32))
            row["data"] = None
        shingle, owner, where = np.concatenate(shingles), np.concatenate(owners), np.concatenate(of)
        del shingles, owners, of
        order = np.argsort(shingle, kind="stable")
        shingle = shingle[order]
        start = np.flatnonzero(np.concatenate(([True], shingle[1:] != shingle[:-1])))
        count = np.diff(np.append(start, len(shingle)))
        count = np.repeat(count, count)
        keep = count > 1
        shingle, count, order = shingle[keep], count[keep], order[keep]
        owner, where = owner[order], where[order]
        order = np.argsort(where, kind="stable")
        shingle, count, owner, where = shingle[order], count[order], owner[order], where[order]
        edges = np.searchsorted(where, np.arange(len(rows) + 1))
        yield made([(r["bin"], r["slice"], 1, numbers(gaps(shingle[x:y]), count[x:y].astype("<u4"), owner[x:y])) for r, x, y in zip(rows, edges[:-1], edges[1:], strict=True) if y > x])


_FOUND = "key long, mark long, size long, shingles binary, counts binary"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A slice's table and its shared shingles -> its documents (shingles null), and the sets that can link: rarest shared shingle first, with counts."""

    def rows_of(key: list, mark: np.ndarray, size: np.ndarray, shingles: list, counts: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(mark), pa.array(size), pa.array(shingles, pa.binary()), pa.array(counts, pa.binary())], names=["key", "mark", "size", "shingles", "counts"])

    for rows in _grouped(batches, "slice"):
        table = next(r["data"] for r in rows if r["kind"] == 0)
        marks, total, keys, every, sizes = pickle.loads(table)
        yield rows_of(keys, every, sizes, [None] * len(keys), [None] * len(keys))
        parts = [from_numbers(r["data"], "<u8", "<u4", "<u2") for r in rows if r["kind"] == 1]
        if not parts:
            continue
        shingle = np.concatenate([np.cumsum(p[0]) for p in parts])
        count, owner = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        order = np.lexsort((shingle, count, owner))
        shingle, count, owner = shingle[order], count[order], owner[order]
        edges = np.searchsorted(owner, np.arange(len(marks) + 1))
        good = np.flatnonzero(np.diff(edges) >= needed(total))
        for at in range(0, len(good), 256):
            some = good[at : at + 256]
            yield rows_of([None] * len(some), marks[some], total[some], [shingle[edges[i] : edges[i + 1]].tobytes() for i in some], [count[edges[i] : edges[i + 1]].tobytes() for i in some])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (shingle, mark) in order of the shingle -> a forest that connects the sets of each shingle."""
    forest, last, first = Forest(), None, 0
    for batch in batches:
        for shingle, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if shingle == last:
                forest.join(first, mark)
            else:
                last, first = shingle, mark
        if len(forest.parent) > 500_000:
            yield _edges(forest)
            forest = Forest()
    yield _edges(forest)


def _edges(forest: Forest) -> pa.RecordBatch:
    pairs = [(x, r) for x in forest.parent if (r := forest.find(x)) != x]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


class Trie:
    """Sets in global order (most frequent shingle first) as a tree of runs of shingles; a run ends where sets part."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int]):
        self.sets, self.sizes = sets, sizes
        self.nodes: list[tuple] = []  # run, children, sets that end here, least and largest size below
        self._build(sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes()))

    def _build(self, order: list[int]) -> None:
        # an explicit stack: sets can be long
        todo = [(order, 0, [])]
        while todo:
            members, depth, beside = todo.pop()
            first, last = self.sets[members[0]], self.sets[members[-1]]
            most = min(len(first), len(last)) - depth
            differ = np.flatnonzero(first[depth : depth + most] != last[depth : depth + most])
            shared = int(differ[0]) if len(differ) else most
            run, depth = first[depth : depth + shared], depth + shared
            rest = [i for i in members if len(self.sets[i]) > depth]
            children: list[int] = []
            beside.append(len(self.nodes))
            self.nodes.append((run, children, [i for i in members if len(self.sets[i]) == depth], min(self.sizes[i] for i in members), max(self.sizes[i] for i in members)))
            at = 0
            while at < len(rest):
                to, head = at, self.sets[rest[at]][depth]
                while to < len(rest) and self.sets[rest[to]][depth] == head:
                    to += 1
                todo.append((rest[at:to], depth, children))
                at = to

    def links(self, probes: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (probe, set of the tree) that link. The tree is walked once, with all probes that can still link below a node and their overlaps so far.

        What a run adds to a probe's overlap counts for all sets below it. A probe leaves a subtree when even a full match of what
        remains of it falls short of the overlap that the smallest set below needs, or when sizes are too far apart.
        """
        size, length = np.array(sizes, np.int64), np.array([len(p) for p in probes])
        flat, owner = np.concatenate(probes), np.repeat(np.arange(len(probes)), length)
        kinds = 1 + max(int(flat.max(initial=0)), max((int(s[-1]) for s in self.sets if len(s)), default=0))
        order = np.argsort(flat, kind="stable")
        holder, begin = owner[order], np.searchsorted(flat[order], np.arange(kinds + 1))
        place, edge = owner * kinds + flat, np.cumsum(length) - length
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(0, np.arange(len(probes)), np.zeros(len(probes), np.int64))]
        while todo:
            node, alive, overlap = todo.pop()
            run, children, ends, least, largest = self.nodes[node]
            near = (largest * 100 >= size[alive] * PERCENT) & (least * PERCENT <= size[alive] * 100)
            alive, overlap = alive[near], overlap[near]
            if not len(alive):
                continue
            left = length[alive]
            if len(run):
                number = begin[run + 1] - begin[run]
                held = holder[np.repeat(begin[run] - np.cumsum(number) + number, number) + np.arange(number.sum())]
                overlap = overlap + np.bincount(held, minlength=len(probes))[alive]
                # of a probe, what comes after the run's last shingle in the global order
                left = left - (np.searchsorted(place, alive * kinds + run[-1], side="right") - edge[alive])
            for i in ends:
                linked = alive[overlap * (100 + PERCENT) >= PERCENT * (size[alive] + self.sizes[i])]
                found.append((linked, np.full(len(linked), i)))
            if children:
                must = -(-(size[alive] + np.maximum(least, needed(size[alive]))) * PERCENT // (100 + PERCENT))
                go = overlap + left >= must
                if go.any():
                    todo += [(child, alive[go], overlap[go]) for child in children]
        return np.concatenate([a for a, _ in found] or [edge[:0]]), np.concatenate([b for _, b in found] or [edge[:0]])


def _rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n places the least that it is connected with by pairs."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of candidate sets, or pairs of blocks of one, whose sets are linked across only -> (a, b): a forest of the links; (a, n): to how many documents a set's links lead."""
    for rows in _grouped(batches, "task"):
        across = rows[0]["across"]
        blocks = sorted({r["block"] for r in rows})
        if len(rows) < 2 or across and len(blocks) < 2:
            continue
        every = [np.frombuffer(r["shingles"], U64) for r in rows]
        count = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
        shingle, at, index = distinct(np.concatenate(every))
        rank = np.empty(len(shingle), np.int64)
        rank[np.lexsort((shingle, -count[at].astype(np.int64)))] = np.arange(len(shingle))
        edges = np.concatenate(([0], np.cumsum([len(x) for x in every])))
        sets = [np.sort(rank[index[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]
        sizes = [r["size"] for r in rows]
        mine = np.flatnonzero([not across or r["block"] == blocks[0] for r in rows])
        other = np.flatnonzero([r["block"] != blocks[0] for r in rows]) if across else mine
        a, b = Trie([sets[i] for i in mine], [sizes[i] for i in mine]).links([sets[i] for i in other], [sizes[i] for i in other])
        a, b = other[a], mine[b]
        a, b = a[a != b], b[a != b]
        copies, marks = np.array([r["copies"] for r in rows]), np.array([r["mark"] for r in rows])
        number = np.bincount(a, copies[b], len(rows))
        if across:
            number += np.bincount(b, copies[a], len(rows))
        root = _rooted(len(rows), a, b)
        below, linked = np.flatnonzero(root != np.arange(len(rows))), np.flatnonzero(number)
        none = pa.nulls(len(linked), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(marks[below]), pa.array(marks[root[below]]), pa.nulls(len(below), pa.int64())], names=["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(marks[linked]), none, pa.array(number[linked].astype(np.int64))], names=["a", "b", "n"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, n_links for every row: the least key reachable by links of Jaccard similarity 0.75 or more, itself included, and the number of other rows that it links with.

    Whole texts, all rows, no limit on sets, links or candidates:

    1. Equal sets are one (by a 64-bit hash of the set). Shingles of the distinct sets are dealt to bins as packed numbers; a bin keeps
       those that two sets or more have, and counts the sets.
    2. A set fewer than 75% of whose shingles are shared links with none. For the others the rarest 25% (and one) of their shingles,
       those that none shares first, must hold a shingle of every set that they link with: sets connected by such shingles are a group.
    3. Each group's sets become a tree, walked once with all sets. A group of more than BLOCK sets is dealt out as pairs of blocks, so
       that every two sets meet in one task. Tasks give numbers of links and forests of links; the forests' components are the result.

    Without words or text a row has 0 shingles and is its own component; a row with a null key has the least key it is linked with, null
    if none. Rows of one key with different texts are documents of their own. An empty table gives none; other columns are ignored.
    Keys are whole numbers.
    """
    spark = df.sparkSession
    bins = 2 * _work.parts(spark)
    shared = _work.by_bin(_dealt(df, key, text, bins), "bin", "kind", "slice").mapInArrow(tidy(_shared), "bin int, slice long, kind int, data binary")
    found = _work.written(_work.by_bin(shared, "slice", "kind", "bin").mapInArrow(tidy(_candidates), _FOUND), "sets")
    documents = _work.written(found.filter("shingles IS NULL").select("key", "mark", "size"), "documents")
    classes = documents.filter("size > 0").groupBy("mark").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    classes = _work.written(classes, "classes")
    sets = found.filter("shingles IS NOT NULL").select("mark", "size", "shingles", "counts").dropDuplicates(["mark"])
    sets = _work.written(sets.join(classes.select("mark", "copies"), "mark"), "distinct-sets")
    _work.forget(found)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, marks = [], []
            for row in batch.to_pylist():
                own = np.frombuffer(row["shingles"], np.int64)
                length = row["size"] - needed(row["size"]) + 1 - (row["size"] - len(own))
                shingles.append(own[: max(0, length)])
                marks.append(np.full(len(shingles[-1]), row["mark"], np.int64))
            if shingles:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles)), pa.array(np.concatenate(marks))], names=["shingle", "mark"])

    postings = _work.by_bin(sets.select("mark", "size", "shingles").mapInArrow(tidy(prefixes), "shingle long, mark long"), "shingle")
    groups = components(postings.mapInArrow(tidy(_stars), "a long, b long"))
    number = groups.groupBy("component").agg(F.count("*").alias("n"))
    sized = _work.attached(groups, number, "component", number.filter(_work.is_hot(F.col("n"), groups.count())))
    blocks = F.greatest(F.ceil(F.col("n") / (BLOCK // 2)).cast("int"), F.lit(1))
    whole = F.col("n") <= BLOCK
    # a set of block i goes to each pair of blocks that has i; one block is one task
    block = F.when(whole, 0).otherwise(F.pmod(F.xxhash64("id"), blocks)).cast("int")
    tasks = sized.withColumn("block", block).withColumn("other", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))))
    tasks = tasks.select("id", "block", (F.col("other") != F.col("block")).alias("across"), F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    joined = tasks.join(sets, F.col("id") == F.col("mark")).drop("id")
    links = _work.written(_work.by_bin(joined, "task", "mark").mapInArrow(tidy(_joined), "a long, b long, n long"), "found-links")
    _work.forget(groups, sets)
    near = components(links.filter("b IS NOT NULL").select("a", "b"))
    number = links.filter("b IS NULL").groupBy(F.col("a").alias("mark")).agg(F.sum("n").alias("links"))
    # documents of one set, then sets of one component, then rows of one key
    named = classes.join(near, F.col("mark") == F.col("id"), "left").join(number, "mark", "left")
    named = named.select("mark", F.coalesce("component", "mark").alias("class"), "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    named = _work.written(named, "named")
    top = named.groupBy("class").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = _work.attached(named, top.drop("n"), "class", top.filter(_work.is_hot(F.col("n"), named.count())))
    out = _work.attached(documents, named.select("mark", "component_id", "n_links"), "mark", classes.filter(_work.is_hot(F.col("copies"), documents.count())))
    out = out.select(F.col("key"), F.col("size").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.select(F.col("key").cast(df.schema[key].dataType).alias(key), "n_shingles", F.col("component_id").cast(df.schema[key].dataType), "n_links")
