"""Language-model scores by a probabilistic suffix tree over words, with add-one unigram scores beside them."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.llm import _work
from maxentnet.llm._text import U64, blocks, encoded, from_numbers, gaps, mix, numbers, portions, ranked, release, tidy, words

#: Least occurrences, in the training texts, of a context and of a next symbol with its own entry in one: what occurs once has no others to be
#: scored by. Neither depends on the size of the table.
CONTEXT = 2
ENTRY = 2
#: Least gain (nats an occurrence, each occurrence scored by the others) over the next shorter context.
DIVERGENCE = 0.002
DISCOUNT = 0.75
#: In place of a word's hash: what follows and what precedes a text.
_END, _BEGIN = U64(1), U64(2)
_ODD = U64(0x9E3779B97F4A7C15)
#: Bytes of text in a slice, about, and in the part of it whose words are hashed at once.
_SLICE = 8 << 20
_PART = 1 << 20


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 7 == 2, F.lit(False))


def _add_up(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(count, start) if len(start) else count


def _packed(to: np.ndarray, bins: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(bins + 1))
    columns = tuple(c[order] for c in columns)
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, b"".join(c[edges[k] : edges[k + 1]].tobytes() for c in columns)


def _rows(rows: list[tuple], *kinds: tuple[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], names=[n for n, _ in kinds])


_BIN = (("bin", pa.int32()), ("data", pa.binary()))


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


def _unpacked(rows: list[dict], *kinds: str) -> list[np.ndarray]:
    width = sum(np.dtype(k).itemsize for k in kinds)
    out: list[list] = [[np.zeros(0, k)] for k in kinds]
    for row in rows:
        n, at = len(row["data"]) // width, 0
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(row["data"], kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) for x in out]


def _word_counts(bins: int):
    """Training texts -> counts of each task's words, packed by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, fresh = np.zeros(0, U64), np.zeros(0, np.int64), []
        for batch in portions(batches):
            texts = encoded(batch.column(0))
            for a, b in blocks(texts, _PART):
                fresh.append(np.unique(words(texts[a:b])[0], return_counts=True))
                if sum(len(k) for k, _ in fresh) > 1 << 20:
                    key, count = _add_up(np.concatenate([key, *(k for k, _ in fresh)]), np.concatenate([count, *(c for _, c in fresh)]))
                    fresh = []
                    if len(key) > 1 << 21:
                        yield _rows(list(_packed((key % U64(bins)).astype(np.int64), bins, key, count)), *_BIN)
                        key, count = key[:0], count[:0]
        key, count = _add_up(np.concatenate([key, *(k for k, _ in fresh)]), np.concatenate([count, *(c for _, c in fresh)]))
        yield _rows(list(_packed((key % U64(bins)).astype(np.int64), bins, key, count)), *_BIN)

    return run


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _grouped(batches, "bin"):
        key, count = _add_up(*_unpacked(rows, "<u8", "<i8"))
        yield _rows([(rows[0]["bin"], key.tobytes() + count.tobytes(), len(key), int(count.sum()))], *_BIN, ("words", pa.int64()), ("tokens", pa.int64()))


def freed(total: np.ndarray, entries: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The share that a context's next symbols leave to the next shorter context: of those without an entry, and DISCOUNT of each kind with one."""
    return (total - entries + DISCOUNT * kinds) / np.maximum(total, 1)


def grown(of: np.ndarray, count: np.ndarray, parent: np.ndarray, lone: np.ndarray) -> tuple[np.ndarray, ...]:
    """One level of the tree: of contexts 0, 1, ... the counts of next symbols (a row for each context and next symbol), their chances in the
    next shorter context, and for each context the number of next symbols that occur once, without rows. Gives for each context total,
    occurrences and number of the entries, and whether it stays.

    A next symbol that occurs ENTRY times or more has an entry: its discounted share of the total, and the part of the freed share that
    its parent gives it; all else has the freed share times the parent's chance. A context stays if it occurs CONTEXT times or more and,
    each occurrence scored by the counts of the others, diverges from the next shorter one by DIVERGENCE.
    """
    n = len(lone)
    entry = count >= ENTRY
    total = np.bincount(of, count, n) + lone
    entries, kinds = np.bincount(of, count * entry, n), np.bincount(of, entry, n)
    free = freed(total, entries, kinds)
    others = np.where(entry, np.maximum(count - 1 - DISCOUNT, 0) / np.maximum(total[of] - 1, 1), 0.0) + free[of] * parent
    gain = np.bincount(of, count * np.log(np.maximum(others, 1e-300) / parent), n) + (total - np.bincount(of, count, n)) * np.log(np.maximum(free, 1e-300))
    return total, entries, kinds, (total >= CONTEXT) & (kinds > 0) & (gain > DIVERGENCE * total)


def rounded(chance: np.ndarray) -> np.ndarray:
    """Chances as 2 bytes: -log2 in steps of 1/1024. What diverges is told by these; scores have the chances themselves."""
    return np.clip(np.rint(-1024 * np.log2(chance.astype(np.float64))), 0, 65535).astype("<u2")


_SENT = (("bin", pa.int32()), ("slice", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("alive", pa.int64()))
_SENT_DDL = "bin int, slice long, kind int, data binary, alive long"
#: Kinds of rows: a bin's vocabulary, the places of a slice's texts and state, what is asked of a bin or answered to a slice.
VOCABULARY, STATE, ASKED = -1, 1, 2
#: In an answer: no longer context is looked at; it is, but this one isn't kept; this one is kept.
DONE, PASSED, KEPT = 0, 1, 2


def _sent(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 256):
        yield _rows(rows[at : at + 256], *_SENT)


def _texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Slices of texts: keys, whether held out, sizes in symbols (an END after each text), distinct symbols, and the symbols' indices in these."""
    for batch in portions(batches, 8192):
        texts = encoded(batch.column(2))
        for a, b in blocks(texts, _SLICE):
            parts, sizes = [], []
            for x, y in blocks(texts[a:b], _PART):
                hashes, first = words(texts[a + x : a + y])
                size = np.diff(first) + 1
                symbol = np.full(int(size.sum()), _END)
                word = np.ones(len(symbol), bool)
                word[np.cumsum(size) - 1] = False
                symbol[word] = hashes[first[0] : first[-1]]
                parts.append(symbol)
                sizes.append(size)
            known, _, index = ranked(np.concatenate(parts))
            own = pa.array(range(a, b))
            yield {"key": batch.column(0).take(own), "held": batch.column(1).take(own), "size": np.concatenate(sizes), "words": known, "index": index}


def _sliced(bins: int, base: str):
    """Texts -> files of their slices as numbered words; rows STATE: a slice's place; ASKED: its distinct words, by bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get().partitionId(), _work.Blobs(base)
        for number, texts in enumerate(_texts_of(batches)):
            known, index = texts.pop("words"), texts.pop("index")
            place = out.put(pickle.dumps(texts | {"numbers": numbers(gaps(known), index.astype("<u4"))}, protocol=5))
            name = task << 32 | number
            yield from _sent([(name % bins, name, STATE, pickle.dumps((place, None)), 1)])
            yield from _sent([(k, name, ASKED, d, 0) for k, d in _packed((known % U64(bins)).astype(np.int64), bins, known)])
        out.close()

    return run


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bin's vocabulary and words asked for -> their counts, in the same order."""
    for rows in _grouped(batches, "bin"):
        yield from _sent([tuple(r[n] for n, _ in _SENT) for r in rows if r["kind"] == STATE])
        key, count = _unpacked([r for r in rows if r["kind"] == VOCABULARY], "<u8", "<i8")
        out = []
        for row in rows:
            if row["kind"] == ASKED:
                word = np.frombuffer(row["data"], "<u8")
                i = np.minimum(np.searchsorted(key, word), max(len(key) - 1, 0))
                c = np.where(key[i] == word, count[i], 0) if len(key) else np.zeros(len(word), np.int64)
                out.append((row["bin"], row["slice"], ASKED, numbers(c.astype("<i8")), 0))
        yield from _sent(out)


class Slice:
    """Some texts' places between two levels: ``at``, those still looked at, and ``chance``, theirs in the longest context so far.

    ``rare`` tells of every place whether the run of words that ends there, as long as the last level saw, occurs less than CONTEXT
    times in training. Then a longer context that ends so needs no look, and the last word of the run has no entry in a longer
    context: its chance is only ever multiplied by what contexts free, so it is scored at once, and the factors as they come.
    """

    def __init__(self, rows: list[dict], level: int, totals: tuple[int, int, int, int], texts: str, states: str | None):
        """After what came back of ``level`` (0: the words' counts)."""
        self.bins, tokens, kinds, ends = totals
        self.place, place = pickle.loads(next(r["data"] for r in rows if r["kind"] == STATE))
        own = pickle.loads(_work.blob(texts, self.place))
        self.key, self.held, self.size = own["key"], own["held"], own["size"]
        known, index = from_numbers(own["numbers"], "<u8", "<u4")
        known, n = np.cumsum(known), len(self.size)
        self.owner = np.repeat(np.arange(n), self.size)
        self.symbol = known[index]
        self.begin = np.cumsum(self.size) - self.size
        back = [r["data"] for r in rows if r["kind"] == ASKED]
        if not level:
            self.count = np.empty(len(known), np.int64)
            self.count[np.argsort((known % U64(self.bins)).astype(np.int64), kind="stable")] = np.concatenate([from_numbers(x, "<i8")[0] for x in back])
            self.count[known == _END] = ends
            self.base = np.bincount(self.owner, np.log10(self.count + 1.0)[index], n) - self.size * np.log10(tokens + kinds + 1)
            self.known, self.score = np.bincount(self.owner, (self.count > 0)[index], n).astype(np.int64), np.zeros(n)
            self.at, self.chance, self.rare = np.arange(len(self.owner)), ((self.count + 1) / (tokens + kinds + 1))[index], (self.count < CONTEXT)[index]
            return
        state = pickle.loads(zstandard.ZstdDecompressor().decompress(_work.blob(states, place)))
        self.base, self.known, self.score = state["base"], state["known"], state["score"]
        rare, at = (np.unpackbits(np.frombuffer(state[k], np.uint8), count=len(self.owner)).astype(bool) for k in ("rare", "at"))
        self.rare, at = rare, np.flatnonzero(at)
        lone = rare[at]
        chance = np.ones(len(at))
        (held,) = from_numbers(state["numbers"], "<i8" if level == 1 else "<f4")
        chance[~lone] = (held[index[at[~lone]]] + 1) / (tokens + kinds + 1) if level == 1 else held
        _, of, rest, _, pair = self.runs(level, at)  # as they were asked for
        told = [np.concatenate(x) for x in zip(*(from_numbers(x, "u1", "<u4", "<u4", "<u4", "<u4") for x in back), strict=True)] or [np.zeros(0, np.int64)] * 5
        code, total, entries, kinds_, count = (x.astype(np.int64) for x in told)
        kept = np.flatnonzero(code == KEPT)
        free, every = np.ones(len(code)), np.ones(len(code))
        free[kept], every[kept] = freed(total, entries, kinds_), total
        times = np.zeros(len(at), np.int64)
        times[rest] = count[pair]
        self.rare[at[rest]] = count[pair] < CONTEXT
        code = code.astype("u1")[of]
        entry = np.flatnonzero((times >= ENTRY) & (code == KEPT))
        chance = chance * free[of]
        chance[entry] += (times[entry] - DISCOUNT) / every[of[entry]]
        done = code == DONE
        self.settle(at[done], chance[done])
        self.at, self.chance = at[~done], chance[~done]

    def settle(self, at: np.ndarray, chance: np.ndarray) -> None:
        """These places are scored with these chances."""
        self.score = self.score + np.bincount(self.owner[at], np.log10(chance), len(self.size))

    def runs(self, level: int, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct contexts of ``level`` words of the places, none of which has fewer than ``level`` - 1 words of its text before it (56 bits of their hashes, in order) and the context of each place; the places that are not rare; of these the distinct pairs of a context and a next symbol (32 bits of its hash), and the pair of each."""
        context, factor = np.zeros(len(at), U64), U64(1)
        for k in range(1, level + 1):
            factor = mix(np.array([factor + _ODD]))[0] | U64(1)
            before = self.symbol[at - k]  # of the first place of all the last one, which is not taken
            if k == level:
                before[at - self.begin[self.owner[at]] < k] = _BEGIN
            context += before * factor
        contexts, _, of = ranked(mix(context) >> U64(8))
        rest = np.flatnonzero(~self.rare[at])
        pairs, _, pair = ranked(of[rest].astype(U64) << U64(32) | self.symbol[at[rest]] >> U64(32))
        return contexts, of, rest, pairs, pair

    def ask(self, level: int) -> Iterator[tuple[int, bytes, int]]:
        """What the texts ask of the contexts of ``level`` words, by bin: contexts, how many next symbols of each are asked for and the training occurrences of others, then these next symbols, their chances and training occurrences. Places whose context reaches over the text's begin or is rare are done."""
        inner = self.at - self.begin[self.owner[self.at]]
        before = (inner > 0) & self.rare[np.maximum(self.at - 1, 0)]
        ended = (inner < level - 1) | before
        self.rare[self.at[before]] = True
        lone = self.rare[self.at]
        self.settle(self.at[ended | lone], self.chance[ended | lone])
        self.chance[lone] = 1
        self.at, self.chance = self.at[~ended], self.chance[~ended]
        train = ~self.held.to_numpy(zero_copy_only=False)[self.owner[self.at]]
        contexts, of, rest, pairs, pair = self.runs(level, self.at)
        count = np.bincount(pair, train[rest], len(pairs)).astype("<u4")
        parent = np.empty(len(pairs), self.chance.dtype)
        parent[pair] = self.chance[rest]
        parent = rounded(parent)
        others = np.bincount(of, train, len(contexts)) - np.bincount(of[rest], train[rest], len(contexts))
        size = np.bincount((pairs >> U64(32)).astype(np.int64), minlength=len(contexts))
        edges = np.searchsorted(bin_of(contexts, self.bins), np.arange(self.bins + 1))
        start = np.concatenate(([0], np.cumsum(size)))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[k], edges[k + 1]
            x, y = start[a], start[b]
            yield k, numbers(gaps(contexts[a:b]), size[a:b].astype("<u4"), others[a:b].astype("<u4"), pairs[x:y].astype("<u4"), parent[x:y], count[x:y])

    def state(self, level: int) -> bytes:
        at = np.zeros(len(self.owner), bool)
        at[self.at] = True
        held = {"base": self.base, "known": self.known, "score": self.score, "rare": np.packbits(self.rare).tobytes(), "at": np.packbits(at).tobytes()}
        # chances before the first level follow from the words' counts
        held |= {"numbers": numbers(self.count.astype("<i8")) if level == 1 else numbers(self.chance[~self.rare[self.at]].astype("<f4"))}
        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(held, protocol=5))


def bin_of(context: np.ndarray, bins: int) -> np.ndarray:
    """The bin by the hash's upper bits, in order of the hash."""
    return ((context >> U64(32)) * U64(bins) >> U64(24)).astype(np.int64)


def _asked(level: int, totals: tuple[int, int, int, int], texts: str, before: str | None, after: str):
    """Slices -> files of their states; rows STATE: a slice's places; ASKED, by bin of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _work.Blobs(after)
        for rows in _grouped(batches, "slice"):
            name = rows[0]["slice"]
            own = Slice(rows, level - 1, totals, texts, before)
            rows.clear()
            asked = [(k, name, ASKED, d, 0) for k, d in own.ask(level)]
            yield from _sent([(name % totals[0], name, STATE, pickle.dumps((own.place, out.put(own.state(level)))), 0)])
            yield from _sent(asked)
        out.close()

    return run


def _answered(level: int):
    """A bin's contexts, of all slices -> of each, in the order that they were asked for, what becomes of it and, if kept, total, occurrences and number of its entries; and of each next symbol asked for its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "bin"):
            yield from _sent([tuple(r[n] for n, _ in _SENT) for r in rows if r["kind"] == STATE])
            rows = [r for r in rows if r["kind"] == ASKED]
            if not rows:
                continue
            read = []
            for row in rows:
                first, *others = from_numbers(row["data"], "<u8", "<u4", "<u4", "<u4", "<u2", "<u4")
                read.append((np.cumsum(first), *others))
                row["data"] = None
            contexts, size, lone, next_, parent, count = (np.concatenate(x) for x in zip(*read, strict=True))
            lengths = [(len(r[0]), len(r[3])) for r in read]
            del read
            contexts, _, of = ranked(contexts)
            lone = np.bincount(of, lone, len(contexts))
            pairs, first, pair = ranked(np.repeat(of, size).astype(U64) << U64(32) | next_)
            count = np.bincount(pair, count, len(pairs))
            total, entries, kinds, keep = grown((pairs >> U64(32)).astype(np.int64), count, np.exp2(parent[first] / -1024), lone)
            code = np.where(keep, KEPT, np.where((level == 1) & (total >= CONTEXT), PASSED, DONE)).astype("u1")
            x = y = 0
            for row, (n, m) in zip(rows, lengths, strict=True):
                mine = of[x : x + n]
                kept = mine[keep[mine]]
                told = (code[mine], *(v[kept].astype("<u4") for v in (total, entries, kinds)), count[pair[y : y + m]].astype("<u4"))
                yield from _sent([(row["bin"], row["slice"], ASKED, numbers(*told), int((told[0] != DONE).sum()))])
                x, y = x + n, y + m
            del contexts, of, pairs, first, pair, count
            release()

    return run


_LAST = [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def score(df: DataFrame, key: str = "doc_id", text: str = "text", depth: int | None = None) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; learns from the rows that are not held out.

    Tokens are the lower-cased words of the whole text and one end. base_score adds up log10((c + 1) / (N + V + 1)). score is the log10
    probability under a suffix tree, whose root has those chances: contexts that occur twice or more and diverge from the shorter one
    keep their own next-symbol chances, smoothed by the shorter one's; each token is scored in the longest kept context before it.
    Contexts of one and two words are all tried, longer ones where the next shorter one is kept, of any length or up to ``depth``
    words. The tree is never in one place: level by level, the texts send their contexts to the bins where these are counted over all
    training texts, and get what they need for their chances back; nothing is broadcast. Texts, as numbered words, and their states
    between levels lie in files (spark.checkpoint.dir must be a store that pyarrow opens), and rows have their places. A null text is an
    empty one (its end is a token); a null key is trained on; repeated rows count each; an empty table gives none; without training
    rows N and V are 0. Words, contexts and next symbols in a context are told apart by 64, 56 and 32 bits of their hashes.
    """
    spark = df.sparkSession
    bins = 2 * _work.parts(spark)
    rows = df.select(F.col(key).alias("key"), held_out(key).alias("held_out"), F.col(text).alias("text"))
    train = rows.filter(~F.col("held_out")).select("text")
    ends = df.filter(~held_out(key)).count()
    vocabulary = _work.by_bin(train.mapInArrow(tidy(_word_counts(bins)), "bin int, data binary"), "bin").mapInArrow(tidy(_vocabulary), "bin int, data binary, words long, tokens long")
    vocabulary = _work.written(vocabulary, "vocabulary")
    sums = vocabulary.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    tokens, kinds = sums["tokens"] + ends, sums["words"] + (ends > 0)
    totals = bins, tokens, kinds, ends
    known = vocabulary.select("bin", F.lit(-1).cast("long").alias("slice"), F.lit(VOCABULARY).alias("kind"), "data", F.lit(0).cast("long").alias("alive"))
    texts, states = _work.folder(spark, "slices"), None
    sent = rows.mapInArrow(tidy(_sliced(bins, texts)), _SENT_DDL).unionByName(known)
    back = _work.written(_work.by_bin(sent, "bin", "kind").mapInArrow(tidy(_looked_up), _SENT_DDL), "counts")
    _work.forget(vocabulary)
    level = 0
    while level != depth and back.agg(F.sum("alive")).first()[0]:
        level += 1
        after = _work.folder(spark, "states")
        asked = _work.by_bin(back, "slice", "kind", "bin").mapInArrow(tidy(_asked(level, totals, texts, states, after)), _SENT_DDL)
        new = _work.written(_work.by_bin(asked, "bin", "kind").mapInArrow(tidy(_answered(level)), _SENT_DDL), f"level-{level}")
        _work.forget(back)
        if states:
            _work.delete(spark, states)
        back, states = new, after
    kind_of_key = df.schema[key].dataType.simpleString()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "slice"):
            done = Slice(rows, level, totals, texts, states)
            done.settle(done.at, done.chance)
            made = [done.held, *map(pa.array, (done.size, done.known, np.full(len(done.size), tokens), done.base, done.score))]
            yield pa.RecordBatch.from_arrays([done.key, *(m.cast(kind) for m, (_, kind) in zip(made, _LAST, strict=True))], names=[key, *(n for n, _ in _LAST)])

    return _work.by_bin(back, "slice", "kind", "bin").mapInArrow(tidy(gathered), f"`{key}` {kind_of_key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
