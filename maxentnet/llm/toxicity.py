"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts, over letters within words and words after words, that share the counts of their lower orders."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maxentnet.llm import _work
from maxentnet.llm._text import U64, blocks, joined, mix, prefix_hash, span_hash, tidy

#: Labelled rows that are learned from at most, toxic and ordinary: those whose hashes are least.
MOST_TOXIC, MOST_ORDINARY = 3000, 5000
ORDER = 6
DISCOUNT = 0.75
#: Of a class's own counts; n-grams that so few of its documents have tell nothing of it.
CLASS_DISCOUNT = 4.0
FEATURES = 8
THRESHOLD = 0.7
#: Where a word begins and ends.
BEGIN, END = 1, 2
#: ASCII characters outside words are spaces.
_WORDS = np.array([c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)], np.uint8)
_BLOCK = 1 << 21
_ODD = U64(0x9E3779B97F4A7C15)
#: Models that a worker holds, by place: two halves, or the whole.
_MODELS: dict = {}


def word_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The block's letters, begin and end of each word, and the first word of each text."""
    data, begins = joined(texts)
    data = _WORDS[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], data == 32)).view(np.int8)))
    return data, edge[0::2], edge[1::2], np.searchsorted(edge[0::2], begins)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words as begin, letters, end; and where each begins (and the last ends)."""
    data = np.frombuffer(b"".join(b"\1%b\2" % w for w in words), np.uint8)
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) + 2 for w in words], out=at[1:])
    return data, at


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each order n the n-gram that ends at each place, as a number with its order in the top byte; 0 where a word is too short for it."""
    place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
    key = data.astype(U64)
    for n in range(1, ORDER + 1):
        if n > 1:
            key[n - 1 :] |= data[: len(data) - n + 1].astype(U64) << U64(8 * (n - 1))
        yield np.where(place >= n - 1, key | (U64(n) << U64(56)), U64(0))


class Model:
    """Log-likelihoods of words under both classes.

    A shared Kneser-Ney model pools the classes: order n's probability is the discounted share of the n-gram among those with its
    history, and the freed share goes to order n-1; the highest order, and n-grams at a word's begin, count occurrences, the others
    count the different letters before them. Each class discounts its own counts of n-grams with the longest history there is and
    gives the freed share to the shared model: what is rare in a class is smoothed by what both know, and words new to both differ
    little.

    Words after words are an order above: a class discounts its own counts of a word after another, and the freed share goes to the
    word's own chance in the class.
    """

    def __init__(self, words: list[bytes], counts: np.ndarray, pairs: list[bytes] = (), pair_counts: np.ndarray | None = None, totals: np.ndarray | None = None):
        """``pairs`` are two words with a space between, ``totals`` each class's counts of all pairs with the same first word. Pairs that no class has more than CLASS_DISCOUNT times may be left out."""
        self._letters(words, counts)
        first, second = ([p.split(b" ")[i] for p in pairs] for i in (0, 1))
        before, pair = hashes_of(first), pair_hash(hashes_of(first), hashes_of(second))
        left = np.maximum(pair_counts - CLASS_DISCOUNT, 0) if len(pairs) else np.zeros((0, 2))
        order = np.argsort(pair)
        self.pair, self.left = pair[order], left[order]
        self.before, at, of = np.unique(before, return_index=True, return_inverse=True)
        self.after = totals[at].astype(np.float64) if len(pairs) else np.zeros((0, 2))
        self.unused = self.after - np.stack([np.bincount(of, left[:, c], len(self.before)) for c in (0, 1)], 1)

    def _letters(self, words: list[bytes], counts: np.ndarray) -> None:
        data, at = spelled(words)
        owner = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(at))
        keys, values = [], []
        for gram in grams(data, at):
            used = np.flatnonzero(gram)
            used = used[data[used] != BEGIN]  # the begin mark follows nothing
            key, inverse = np.unique(gram[used], return_inverse=True)
            keys.append(key)
            values.append(np.stack([np.bincount(inverse, counts[owner[used], c], len(key)) for c in (0, 1)], 1).astype(np.float32))
        for n in range(1, ORDER + 1):
            key, seen = keys[n - 1], values[n - 1]
            pooled = seen.sum(1)
            if n < ORDER:
                shorter = np.searchsorted(key, (keys[n] & U64((1 << (8 * n)) - 1)) | (U64(n) << U64(56)))
                top = ((key >> U64(8 * (n - 1))) & U64(255)) == BEGIN
                pooled, seen = np.where(top, pooled, np.bincount(shorter, minlength=len(key))), seen * top[:, None]
            values[n - 1] = np.column_stack((seen, pooled)).astype(np.float32)
        self.key = np.concatenate(keys)
        self.count = np.concatenate(values)
        # of histories: the sum of what follows
        self.history, inverse = np.unique(_history(self.key), return_inverse=True)
        self.total = np.stack([np.bincount(inverse, self.count[:, c], len(self.history)) for c in range(3)], 1).astype(np.float32)
        left = np.column_stack((np.maximum(self.count[:, :2] - CLASS_DISCOUNT, 0), np.maximum(self.count[:, 2] - DISCOUNT, 0)))
        self.freed = self.total - np.stack([np.bincount(inverse, left[:, c], len(self.history)) for c in range(3)], 1).astype(np.float32)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihoods (ordinary, toxic) of each word."""
        if len(words) > 1 << 14:
            return np.concatenate([self(words[i : i + (1 << 14)]) for i in range(0, len(words), 1 << 14)])
        data, at = spelled(words)
        shared, chance = np.full(len(data), 1 / 256), np.ones((len(data), 2))
        place = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
        for n, gram in enumerate(grams(data, at), 1):
            used = np.flatnonzero((gram > 0) & (place > 0))
            g = gram[used]
            i, found = _find(self.key, g)
            j, known = _find(self.history, _history(g))
            count = np.where(found[:, None], self.count[i], 0)
            total, freed = np.where(known[:, None], self.total[j], 0), self.freed[j]
            part = _discounted(count[:, 2] - DISCOUNT, total[:, 2], freed[:, 2], shared[used])
            shared[used] = part
            top = (place[used] == n - 1) | (n == ORDER)
            for c in (0, 1):
                chance[used[top], c] = _discounted(count[top, c] - CLASS_DISCOUNT, total[top, c], freed[top, c], part[top])
        return np.add.reduceat(np.log(chance), at[:-1], axis=0) if len(words) else np.zeros((0, 2))


def hashes_of(words: list[bytes]) -> np.ndarray:
    data, begins = joined(words)
    return span_hash(prefix_hash(data), begins[:-1], begins[1:] - 1)


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ODD + second)


def _history(gram: np.ndarray) -> np.ndarray:
    order = gram >> U64(56)
    return np.where(order > U64(1), ((gram & U64((1 << 56) - 1)) >> U64(8)) | ((order - U64(1)) << U64(56)), U64(0))


def _discounted(count: np.ndarray, total: np.ndarray, freed: np.ndarray, lower: np.ndarray) -> np.ndarray:
    return np.where(total > 0, (np.maximum(count, 0) + freed * lower) / np.maximum(total, 1e-9), lower)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


class Reader:
    """Features of texts under a model. The words of a task are scored once each."""

    def __init__(self, model: Model):
        self.model = model
        self.seen = np.zeros(0, U64)
        self.chance = np.zeros((0, 2))
        self.before = np.zeros(0, np.int64)

    def _known(self, hashes: np.ndarray, at: np.ndarray, word) -> np.ndarray:
        """Places in ``seen`` of distinct words; new ones are scored."""
        i, found = _find(self.seen, hashes)
        if found.all():
            return i
        score = self.model([word(k) for k in at[~found]])
        if len(self.seen) > 500_000:  # bounded; what is dropped is scored again when met
            self.seen, self.chance = hashes[found], self.chance[i[found]]
        seen, chance = np.concatenate((self.seen, hashes[~found])), np.concatenate((self.chance, score))
        order = np.argsort(seen)
        self.seen, self.chance = seen[order], chance[order]
        j, is_before = _find(self.model.before, self.seen)
        self.before = np.where(is_before, j, -1)
        return np.searchsorted(self.seen, hashes)

    def _after(self, hashes: np.ndarray, chance: np.ndarray, before: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods of each place's word after the one before it, and whether a class knows the two together."""
        follows = before[:-1] >= 0
        follows[first[(first > 0) & (first < len(hashes))] - 1] = False
        at = np.flatnonzero(follows) + 1
        i, found = _find(self.model.pair, pair_hash(hashes[at - 1], hashes[at]))
        left = np.where(found[:, None], self.model.left[i] if len(self.model.pair) else 0, 0)
        total, unused = self.model.after[before[at - 1]], self.model.unused[before[at - 1]]
        with np.errstate(divide="ignore"):
            new = np.logaddexp(np.log(left), np.log(unused) + chance[at]) - np.log(np.maximum(total, 1e-300))
        out, known = chance.copy(), np.zeros(len(hashes), bool)
        out[at] = np.where(total > 0, new, chance[at])
        known[at] = (left > 0).any(1)
        return out, known

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: 1, length-normalised difference of the log-likelihoods, the three largest differences of a word (0 where there are fewer words), log of the number of words; the length-normalised difference of words after words, and the largest gain of it over the words alone among two words that a class knows together."""
        out = []
        for a, b in blocks(texts, _BLOCK):
            data, start, end, first = word_table(texts[a:b])
            if not len(start):
                out.append(np.zeros((b - a, FEATURES)) + np.eye(FEATURES)[0])
                continue
            hashes, at, inverse = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
            raw = data.tobytes()
            i = self._known(hashes, at, lambda k, raw=raw, start=start, end=end: raw[start[k] : end[k]])[inverse]
            alone = self.chance[i]
            after, known = self._after(hashes[inverse], alone, self.before[i], first)
            ratio, joint = alone[:, 1] - alone[:, 0], after[:, 1] - after[:, 0]
            gain = np.where(known, joint - ratio, 0)
            rows = np.zeros((b - a, FEATURES))
            rows[:, 0] = 1
            for k in range(b - a):
                x, y = first[k], first[k + 1]
                if y > x:
                    own = ratio[x:y]
                    top = np.zeros(3)
                    top[: len(own)] = np.sort(np.partition(own, max(0, len(own) - 3))[-3:])[::-1]
                    rows[k, 1:] = own.mean(), *top, np.log(len(own)), joint[x:y].mean(), max(gain[x:y].max(), 0)
            out.append(rows)
        return np.concatenate(out) if out else np.zeros((0, FEATURES))


def lowered(column: pa.Array) -> list[bytes]:
    return [(x or "").lower().encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of the features, the first of which is 1. The penalty is on features in units of their spread."""
    spread = np.maximum(x.std(0), 1e-9)
    spread[0] = 1
    x = x / spread
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / spread


def loaded(base: str, place: tuple[str, int, int]) -> Model:
    """A model from its file; a worker keeps the last two for its later tasks."""
    if place not in _MODELS:
        while len(_MODELS) > 1:
            _MODELS.pop(next(iter(_MODELS)))
        _MODELS[place] = pickle.loads(_work.blob(base, place))
    return _MODELS[place]


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def score(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, held_out, score (0 to 1), predicted (1 if score >= THRESHOLD), and the columns in ``keep``, for every row of ``df``; only texts enter a score.

    Learns from labelled rows that are not held out, MOST_TOXIC and MOST_ORDINARY of them at most. Words are compared letter by
    letter, and after the word before them, under both models; a logistic function of the features, fitted on halves that the models
    of the other halves score, turns them into a chance at the labels' own share of toxic ones, whatever the caps leave. The models
    are built in one task and lie in a file, which each worker reads once (spark.checkpoint.dir must be a store that pyarrow opens). A null text is an empty one, with the features of no words; a null key is never held out nor labelled; of
    several labels for a key the largest holds; repeated rows get repeated results; other columns are ignored. With labels of
    one class only (or none), every score is the share of toxic labels, one of each added.
    """
    spark = df.sparkSession
    known = labels.select(F.col(key).alias("lk"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out("lk")).groupBy("lk").agg(F.max("y").alias("y"))
    order = F.xxhash64(F.lit("sample"), "lk")
    some = [known.filter(F.col("y") == y).withColumn("o", order).orderBy("o").limit(most) for y, most in ((1, MOST_TOXIC), (0, MOST_ORDINARY))]
    sample = some[0].unionByName(some[1])  # at most MOST_TOXIC + MOST_ORDINARY keys
    fold = F.pmod(F.xxhash64(F.lit("fold"), "lk"), F.lit(2)).cast("int")
    learn = _work.written(df.select(key, text).join(F.broadcast(sample), F.col(key) == F.col("lk")).select(text, "y", fold.alias("fold")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found: dict = {}
                for x, y, f in zip(lowered(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data, start, end, _ = word_table([x])
                    raw = data.tobytes()
                    words = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                    for w in {*words, *(b"%b %b" % p for p in zip(words, words[1:], strict=False))}:
                        k = (w, 2 * f + y)
                        found[k] = found.get(k, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.binary()), pa.array([c for _, c in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["word", "c", "n"])

    classes = [f"n{c}" for c in range(4)]  # ordinary and toxic of each half
    table = learn.mapInArrow(tidy(count), "word binary, c int, n long").groupBy("word").agg(*(F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(n) for c, n in enumerate(classes)))
    is_pair = F.col("word").cast("string").contains(" ")
    table = _work.written(table.withColumn("before", F.when(is_pair, F.substring_index(F.col("word").cast("string"), " ", 1))), "toxic-words")
    total = table.filter("before IS NOT NULL").groupBy("before").agg(*(F.sum(n).alias(f"t{n}") for n in classes))
    often = F.greatest(F.col("n0") + F.col("n2"), F.col("n1") + F.col("n3")) > CLASS_DISCOUNT
    used = table.filter("before IS NULL").select("word", *classes, *(F.lit(0).cast("long").alias(f"t{n}") for n in classes)).unionByName(table.filter(often).join(total, "before").drop("before"))
    base = _work.folder(spark, "toxic-models")

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        whole = pa.Table.from_batches(held)
        words = whole.column("word").to_pylist()
        n, t = (np.stack([whole.column(f"{k}{c}").to_numpy() for c in range(4)], 1) for k in ("n", "tn")) if words else (np.zeros((0, 4)),) * 2
        pair = np.array([b" " in w for w in words], bool)
        del whole, held
        out, places = _work.Blobs(base), {}

        def model(counts: np.ndarray, totals: np.ndarray) -> tuple[str, int, int]:
            some = counts.sum(1) > 0
            one, two = np.flatnonzero(some & ~pair), np.flatnonzero(some & pair)
            return out.put(pickle.dumps(Model([words[i] for i in one], counts[one], [words[i] for i in two], counts[two], totals[two]), protocol=5))

        if n[~pair][:, 1::2].any() and n[~pair][:, 0::2].any():
            places["whole"] = model(n[:, :2] + n[:, 2:], t[:, :2] + t[:, 2:])
            for f in (0, 1):
                own = slice(2 * (1 - f), 2 * (1 - f) + 2)
                places[f] = model(n[:, own], t[:, own]) if n[~pair][:, own].any(0).all() else places["whole"]
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(places)], pa.binary())], names=["places"])

    # one task builds the models, which the bounds on labelled rows bound
    made = used.orderBy("word").coalesce(1).mapInArrow(tidy(built), "places binary").first()
    models = pickle.loads(made[0]) if made else {}
    every = {r["y"]: r["n"] for r in known.filter(F.col("y").isin(0, 1)).groupBy("y").agg(F.count("*").alias("n")).collect()}
    seen = {y: min(n, MOST_TOXIC if y else MOST_ORDINARY) for y, n in every.items()}
    alone = (every.get(1, 0) + 1) / (every.get(0, 0) + every.get(1, 0) + 2)
    weights = None
    if len(seen) == 2 and models:

        def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            readers = [Reader(loaded(base, models[f])) for f in (0, 1)]
            for batch in batches:
                folds = batch.column(2).to_numpy()
                texts = lowered(batch.column(0))
                rows = np.zeros((len(texts), FEATURES))
                for f in (0, 1):
                    mine = np.flatnonzero(folds == f)
                    if len(mine):
                        rows[mine] = readers[f].features([texts[i] for i in mine])
                yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(rows[:, i]) for i in range(FEATURES))], names=["y", *(f"f{i}" for i in range(FEATURES))])

        fitted = learn.mapInArrow(tidy(featured), "y int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toArrow()
        weights = logistic(np.stack([fitted.column(f"f{i}").to_numpy() for i in range(FEATURES)], 1), fitted.column("y").to_numpy())
        # the caps change the classes' shares; a score is a chance at the labels' own
        weights[0] += np.log(every[1] / every[0]) - np.log(seen[1] / seen[0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(loaded(base, models["whole"])) if weights is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                if reader is None:
                    values = np.full(part.num_rows, alone)
                else:
                    values = 1 / (1 + np.exp(-np.clip(reader.features(lowered(part.column(1))) @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(values), pa.array((values >= THRESHOLD).astype(np.int32)), *(part.column(i) for i in places)], names=[key, "held_out", "score", "predicted", *keep])

    others = [c for c in keep if c != text]  # the text travels once
    places = [1 if c == text else 3 + others.index(c) for c in keep]
    source = df.select(key, F.col(text).alias("_text"), held_out(key).alias("_held"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(others)))
    kept = "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(tidy(scored), f"`{key}` {source.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int{kept}")
