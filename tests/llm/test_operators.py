"""Each operator against brute force on small tables that hold nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maxentnet.llm import _work, fingerprints, licenses, lm, media, mixing, ngram_join, packing, suffix_array, suffix_dedup, toxicity, warc
from maxentnet.llm._text import mix
from maxentnet.llm.components import components
from maxentnet.llm.queries import tokenizer_path

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(4)
WORDS = ["".join(RNG.choice(list("abcdeéßñ"), RNG.integers(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


LONG = prose(30_000)
BASE = prose(80)


def edited(text, *places):
    words = text.split()
    for p in places:
        words[p] = "zz"
    return " ".join(words)


ROWS = [
    (1, BASE, "b"), (2, BASE, "a"), (3, edited(BASE, 40), "a"), (4, edited(BASE, 3, 77), None), (5, edited(BASE, 10, 20, 30, 50, 60, 70), "a"),
    (6, None, "a"), (7, "", None), (8, "  \n\t ", "b"), (9, "One", "c"), (10, "one", "c"), (11, "Two Words", "c"), (12, LONG, "d"),
    (13, prose(50) + " " + BASE, "a"), (14, "MIT License. mit\nlicense, Apache-License and GNU General Public License, version 3", "a"),
    (15, "x\n# SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\n", "a"),
    (16, "a" * 5000, "e"), (17, "b" + "a" * 300, "e"), (18, "日本語 テキスト " * 30, "f"), (19, "日本語 テキスト " * 29, "f"), (20, "x\x00\x00", "f"), (21, "x", "f"),
    (22, "word " * 200, "g"), (22, "word " * 200, "g"), (None, BASE, "g"), (None, None, None), (7 * 10**9, prose(400), "h"),
]
ROWS += [(100 + i, prose(60), "h") for i in range(25)]


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names an operator may use inside
    return spark.createDataFrame([(*r, 1, "x", 2.0) for r in ROWS], "doc_id long, text string, source string, size int, bin string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_licenses(docs, none):
    rows = {(r["doc_id"], r["n_words"]): r for r in licenses.scan(docs).collect()}
    assert len(licenses.scan(docs).collect()) == len(ROWS) and licenses.scan(none).count() == 0
    phrases = {tuple(k.split()): v for k, v in licenses.BASE.items()}
    for key, text, _ in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        at = [(i, v) for i in range(len(words)) for p, v in phrases.items() if tuple(words[i : i + len(p)]) == p]
        r = rows[key, len(words)]
        assert r["n_base"] == len(at) and r["first_word"] == min((i for i, _ in at), default=None) and r["last_word"] == max((i for i, _ in at), default=None)
        assert r["base_labels"] == ",".join(sorted({v for _, v in at})) and 0 <= r["score"] <= 1
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    spdx = next(r for (k, _), r in rows.items() if k == 15)
    assert spdx["labels"] == "bsd-3-clause,gpl-2.0-only,mit" and spdx["freedom"] == 1.0 and spdx["expressions"] == ["MIT GPL-2.0-only Classpath-exception-2.0 with or BSD-3-Clause and"]


@pytest.mark.parametrize(
    ("text", "postfix"),
    [("MIT", ["MIT"]), ("A or B and C", ["A", "B", "C", "and", "or"]), ("(A OR B) AND C", ["A", "B", "or", "C", "and"]), ("A with X and B", ["A", "X", "with", "B", "and"]), ("MIT and then (", ["MIT", "then", "and"]), ("and A", []), ("(A", []), ("", []), ("A) or B", ["A"])],
)
def test_licence_expressions(text, postfix):
    assert licenses.to_postfix(text) == postfix


@pytest.mark.parametrize(
    ("text", "labels", "expressions"),
    [
        ("SPDX-License-Identifier: MIT SPDX-License-Identifier: Apache-2.0", "apache-2.0,mit", ["MIT", "Apache-2.0"]),
        ("x spdx" + "-" * 10 + "LICENSE" + " \n" * 20 + "Identifier = (MIT or ISC) */\nMIT", "isc,mit", ["MIT ISC or"]),
        ("SPDX License Identifier\nMIT", "", []),
        ("é SPDX-License-Identifier: ISC é\n" * 3, "isc", ["ISC"] * 3),
        ("spdx-license-identifierx: MIT", "", []),
        ("SPDX-License-Identifier: " + " or ".join(["MIT"] * 20_000), "mit", [" ".join(["MIT", *["MIT or"] * 19_999])]),
    ],
)
def test_licence_tags(text, labels, expressions):
    got = licenses.Scanner()(text.encode())
    assert (got["labels"], got["expressions"]) == (labels, expressions)


def test_media(spark, docs, none):
    got = by_row(media.media_columns(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = Counter()
    for key, text, _ in ROWS:
        raw = (text or "").encode()
        p = media.padded(raw)
        assert len(p) % 64 == 0 and len(p) > 0 and media.from_png(media.to_png(p)) == p
        want[key, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == want and media.media_columns(none).count() == 0
    places = by_row(media.media_columns(docs).filter("doc_id IN (1, 2)"), "shard", "offset", "media_sha256", "feature")
    assert len(places) == 1
    with pytest.raises(ValueError):
        media.png_header(b"x" * 33)
    # the stored form is the same for equal payloads, and what another reader of pictures would decode
    forms = {}
    for r in media.media_columns(docs).collect():
        text = next((t or "").encode() for k, t, _ in ROWS if k == r["doc_id"] and len((t or "").encode()) == r["n_bytes"])
        p = text + b"\0" * (64 if not text else -len(text) % 64)
        picture = media.to_png(p)
        assert (r["media_bytes"], r["media_sha256"], r["width"], r["height"]) == (len(picture), hashlib.sha256(picture).hexdigest(), 64, len(p) // 64)
        lines = zlib.decompress(picture[41 : 41 + int.from_bytes(picture[33:37], "big")])
        assert b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65)) == p
        mean = sum(p) / len(p)
        strips = np.array_split(np.frombuffer(p, np.uint8), 64)
        bits = "".join("1" if len(x) and sum(map(int, x)) / len(x) > mean or not len(x) and 0 > mean else "0" for x in strips)
        assert r["feature"] == f"{mean:.3f}:{int(bits, 2):016x}"
        assert forms.setdefault(p, r["media_sha256"]) == r["media_sha256"]


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def components_of(rows):
    sets = [(k, sets_of(t)) for k, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(sets)
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    least = {}
    for i, (k, _) in enumerate(sets):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return Counter((k, len(s), least.get(find(i)) if s else k, links[i]) for i, (k, s) in enumerate(sets))


@pytest.mark.parametrize(("block", "hot"), [(ngram_join.BLOCK, _work.HOT), (4, 2)])
def test_ngram_join(spark, docs, none, monkeypatch, block, hot):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(_work, "HOT", hot)
    rows = [(k, t) for k, t, _ in ROWS]
    near = [(1000 + i, edited(BASE, i, (7 * i) % 80)) for i in range(12)]
    df = docs.select("doc_id", "text", "size").union(spark.createDataFrame([(*r, 1) for r in near], "doc_id long, text string, size int"))
    assert by_row(ngram_join.near_duplicates(df), "doc_id", "n_shingles", "component_id", "n_links") == components_of(rows + near)
    if block == 4:
        assert ngram_join.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot", [_work.HOT, 3])
def test_components(spark, monkeypatch, hot):
    monkeypatch.setattr(_work, "HOT", hot)
    path = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100}
    stars = [(i % 3, 10 + i) for i in range(60)] + [(70 + i, 10 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(stars, "a long, b long")).collect()))
    assert got == {i: i % 3 for i in range(3)} | {10 + i: i % 3 for i in range(60)} | {70 + i: i % 3 for i in range(30)} | {10 + i: i % 3 for i in range(60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_names(text):
    """Names of all phrases of a text by a parser of one symbol at a time."""
    full = (1 << 64) - 1
    one = lambda x: int(mix(np.array([x & full], np.uint64))[0])
    base, out, level = 0x9E3779B97F4A7C15, set(), 0
    names = [one(ord(c) + 1) for c in text]
    while names and (level < 2 or len(names) > 1):
        level += 1
        runs = []
        for x in names:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        names = [one(x + one(1) * n) if n > 1 else x for x, n in runs]
        label = names
        for _ in range(3):
            tossed = [label[0] & 1]
            for a, b in zip(label, label[1:], strict=False):
                bit = ((a ^ b) & -(a ^ b)).bit_length() - 1
                tossed.append(2 * bit + (b >> bit & 1))
            label = tossed
        padded = [*label, -1]
        begins = [0] + [i for i in range(2, len(names)) if label[i] > label[i - 1] and label[i] > padded[i + 1]]
        names = [one(sum(names[i] * pow(base, i - a, 1 << 64) for i in range(a, b)) + b - a) for a, b in zip(begins, [*begins[1:], len(names)], strict=True)]
        if level >= fingerprints.LOWEST:
            out |= {one(x + one(level + 1)) for x in names}
    return sorted(out)


def hashed(text):
    return int(np.uint64(xxhash.xxh64(text.encode(), 42).intdigest()).astype(np.int64))


def test_fingerprints(docs, none):
    got = fingerprints.against_next(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1] or "") if r[0] is None else 0, r[1] or ""))
    want = Counter()
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        x, y = a[1] or "", b[1] or ""
        e = fingerprints.edited(x, y)
        own, other, following = (np.array(plain_names(t), np.uint64)[:64] for t in (x, e, y)) if len(x) + len(y) < 5000 else (fingerprints.fingerprints([t])[0] for t in (x, e, y))
        want[a[0], len(x), hashlib.sha256(e.encode()).hexdigest(), fingerprints.text_of(own), fingerprints.text_of(other), fingerprints.likeness(own, other), fingerprints.likeness(own, following)] += 1
    assert Counter(tuple(r) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert by[2]["near_next"] == 1.0 and 0.1 < by[12]["near_edited"] < 0.7
    assert fingerprints.against_next(none).count() == 0 and fingerprints.fingerprint(docs).count() == len(ROWS)
    with pytest.raises(TypeError, match="whole numbers"):
        fingerprints.against_next(docs.withColumn("doc_id", F.col("doc_id").cast("string")))
    small = docs.filter("doc_id < 1000").select(F.col("doc_id").cast("int").alias("doc_id"), "text")
    assert fingerprints.against_next(small).schema["doc_id"].dataType.simpleString() == "int"


def test_next_rows_over_many_ranges(spark):
    rows = [(i % 37 if i % 5 else None, f"{i} {prose(3)}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1]) if r[0] is None else 0, r[1]))
    want = Counter((a[0], hashlib.sha256(fingerprints.edited(a[1], b[1]).encode()).hexdigest()) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert by_row(fingerprints.against_next(df), "doc_id", "edited_sha256") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fingerprints_do_not_depend_on_neighbours():
    rng = np.random.default_rng(7)
    texts = [t or "" for _, t, _ in ROWS[:20]] + ["".join(rng.choice(list("ab c"), rng.integers(0, 60))) for _ in range(200)]
    alone = [fingerprints.fingerprints([t])[0].tolist() for t in texts]
    for _ in range(3):
        order = rng.permutation(len(texts))
        assert [x.tolist() for x in fingerprints.fingerprints([texts[i] for i in order])] == [alone[i] for i in order]
    for t in texts[20:]:
        assert fingerprints.fingerprints([t], None)[0].tolist() == plain_names(t)
    every = fingerprints.fingerprints([LONG, edited(LONG, *range(0, 30_000, 40))], None)
    some = [x[: fingerprints.SAMPLE] for x in every]
    exact = fingerprints.likeness(*every, None)
    assert 0.2 < exact < 0.9 and abs(fingerprints.likeness(*some) - exact) < 0.19  # three standard errors


def test_phrases_do_not_depend_on_offset():
    a, b = fingerprints.fingerprints([LONG[:3000], "shift" + LONG[:3000] + "end"])
    assert fingerprints.likeness(a, b) > 0.8 and fingerprints.likeness(a, fingerprints.fingerprints([LONG[9000:12000]])[0]) < 0.2
    assert fingerprints.fingerprints(["", "a", "aaaa"])[0].size == 0


def test_mixing(docs, none):
    con = pytest.importorskip("duckdb").connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().assign(doc_id=lambda d: d.doc_id.astype("Int64")))
    columns = ("doc_id", "size", "source_size", "target", "taken", "source")
    got = by_row(mixing.mix(docs.drop("size")), *columns)
    assert got == Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.MIX_SQL})").fetchall())
    total, taken = sum(k[1] * n for k, n in got.items()), sum(k[4] * n for k, n in got.items())
    assert total - len({k[5] for k in got}) <= taken <= total and all(k[4] <= 3 * k[1] for k in got)
    assert mixing.mix(none.drop("size")).count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    import duckdb

    rows = [(None, f"word {i % 7} " * (i % 9), "a", 1, 2) for i in range(200)] + [(5, f"again {i}", "b", 3, 4) for i in range(100)] + [(5, "same", None, 3, 4)] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, spread int")
    got = mixing.mix(df, keep=("size", "spread", "text", "source"))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "source", "size_kept", "spread", "text", "source_kept"] and got.count() == 350
    con = duckdb.connect()
    con.register("documents", df.toPandas().astype({"doc_id": "Int64"}))
    columns = ["doc_id", "size", "taken", "source"]
    assert by_row(got, *columns) == Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.MIX_SQL})").fetchall())


def test_mixing_in_many_ranges(docs, monkeypatch):
    before = by_row(mixing.mix(docs.drop("size")), "doc_id", "taken")
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 2)
    assert by_row(mixing.mix(docs.drop("size")), "doc_id", "taken") == before


def test_language_model(docs, none):
    got = lm.score(docs).collect()
    tokens = [(k, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), "\n"]) for k, t, _ in ROWS]
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(w for k, ws in tokens if not out(k) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(k), out(k), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for k, ws in tokens)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and lm.score(none).count() == 0


def test_suffix_tree_is_a_distribution():
    chance = np.array([1, 11, 41, 61, 9]) / 123
    total, entries, kinds, keep = lm.grown(np.array([0, 0, 0]), np.array([5, 90, 1]), chance[[1, 3, 4]], np.array([2]))
    assert (total[0], entries[0], kinds[0], keep.tolist()) == (98, 95, 2, [True])
    free = lm.freed(total, entries, kinds)[0]
    own = free * chance
    own[[1, 3]] += (np.array([5, 90]) - lm.DISCOUNT) / total
    assert own.sum() == pytest.approx(1)


def tree_scores(rows, depth=None):
    """log10 chances of texts under the suffix tree, by dictionaries."""
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    texts = [(k, [*(t or "").split(), "\n"]) for k, t in rows]
    count = Counter(w for k, ws in texts if not out(k) for w in ws)
    n, v = sum(count.values()), len(count)
    chance = {(i, j): (count[w] + 1) / (n + v + 1) for i, (_, ws) in enumerate(texts) for j, w in enumerate(ws)}
    alive, level = set(chance), 0
    while alive and level != depth:
        level += 1
        groups = {}
        for i, j in alive:
            if j >= level - 1:
                groups.setdefault(tuple(texts[i][1][j - k] if j >= k else None for k in range(1, level + 1)), []).append((i, j))
        alive = set()
        for places in groups.values():
            seen = Counter(texts[i][1][j] for i, j in places if not out(texts[i][0]))
            parent = {texts[i][1][j]: chance[i, j] for i, j in places}
            total = sum(seen.values())
            own = {w: c for w, c in seen.items() if c >= 2}
            free = 1 - sum((c - 0.75) / total for c in own.values())
            near = {w: 2 ** (-round(-1024 * math.log2(p)) / 1024) for w, p in parent.items()}
            gain = sum(c * math.log((max(c - 1.75, 0) / (total - 1) if w in own else 0) / near[w] + free) for w, c in seen.items()) if total > 1 else 0
            if keep := total >= 2 and own and gain > 0.002 * total:
                for i, j in places:
                    w = texts[i][1][j]
                    chance[i, j] = ((own[w] - 0.75) / total if w in own else 0) + free * chance[i, j]
            if keep or level == 1 and total >= 2:
                alive.update(places)
    return {k: sum(math.log10(chance[i, j]) for j in range(len(ws))) for i, (k, ws) in enumerate(texts)}, level


def test_contexts_of_any_length_and_table_size(spark):
    held = [k for k in range(5000, 6000) if zlib.crc32(str(k).encode()) % 7 == 2][:2]
    free = [k for k in range(5000) if zlib.crc32(str(k).encode()) % 7 != 2]
    rows = list(zip(free, ["a x y p", "b x y q", "c z y r"] * 6, strict=False)) + [(held[0], "a x y p"), (held[1], "a x y q")]
    rng = np.random.default_rng(1)
    rows += [(k, " ".join(rng.choice(list("abcxypq"), 25))) for k in free[100:130]]
    schema = "doc_id long, text string"
    for depth in (None, 0, 1, 4):
        want, levels = tree_scores(rows, depth)
        got = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame(rows, schema), depth=depth).collect()}
        assert levels > 3 if depth is None else levels == depth
        assert got == pytest.approx(want, abs=1e-4)  # chances travel as 4-byte numbers
    # the third word before tells p from q, on a small table as on one with two million other words
    few = spark.createDataFrame(rows[:20], schema)
    more = spark.range(1, 21).selectExpr("-id AS doc_id", "concat_ws(' ', transform(sequence(1, 100000), i -> concat('w', i % 1000 + 1000 * id))) AS text")
    for df in (few, few.union(more)):
        by = {r["doc_id"]: r["score"] for r in lm.score(df).filter("doc_id > 0").collect()}
        assert by[held[0]] - by[held[1]] > 0.5


def test_warc(spark):
    pages = [(3, "http://a", "<p>x</p>"), (1, None, "<p>x</p>"), (2, "u\r\nv", None), (5, "e", ""), (9, "b", "é" * 4000), (4, "c", "é" * 4000), (None, "d", "<p>x</p>"), (7, "z", "only"), (1, None, "<p>x</p>")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, k int").repartition(2)
    got = by_row(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    first = {}
    for k, _, h in pages:
        if k is not None:
            first[h or ""] = min(first.get(h or "", k), k)
    want = Counter()
    for k, _, h in pages:
        raw = (h or "").encode()
        again = k is not None and k > first[h or ""]
        want[k, len(raw), warc.payload_digest(raw), "revisit" if again else "response", first[h or ""] if again else None] += 1
    assert got == want and warc.round_trip(df.limit(0)).count() == 0
    assert by_row(warc.round_trip(df, least=5), "record_type")["revisit",] < by_row(warc.round_trip(df), "record_type")["revisit",]


def test_warc_reader_rejects():
    digest = warc.payload_digest(b"x")
    good = warc.record(1, "u", b"x", digest, None)
    assert warc.parse(good)["payload"] == b"x" and warc.parse(warc.record(2, "u", b"x", digest, 1))["refers_to"] == 1
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"\r\n\r\nx", b"\r\n\r\ny"), good.replace(b"WARC-Date", b"WARC-Type")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_packing(docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for k, t, _ in ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[k, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)] += 1
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in rows) == want
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_packing_reads_added_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext|", "<|ENDOFTEXT|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in packing.pack(df, tokenizer_path(), ids=True).collect()}
    assert got == {i: [*tok.encode(t, add_special_tokens=False).ids, 0] for i, t in enumerate(texts)} and 50256 in got[0]


def test_packing_in_many_groups(spark, monkeypatch):
    df = spark.createDataFrame([(None, "")] * 300 + [(3, "one two three")] * 300 + [(4, None)] * 50, "doc_id long, text string")
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    rows = packing.pack(df, tokenizer_path()).collect()
    windows = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    groups = Counter(w >> 32 for r in rows for w in [r["sequence_id"]])
    assert len(rows) == 650 and len(groups) == 13 and max(groups.values()) < 100  # equal rows are spread
    for own in windows.values():
        ends = [0, *(o + n for o, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024


def test_other_vocabularies_are_refused(tmp_path):
    import json

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        packing.coder(str(tmp_path / "v.json"))


def test_best_fit_equals_a_plain_search():
    lengths = RNG.integers(1, 1025, 700)
    at, offset = packing.best_fit(lengths)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fit = [(r, w) for w, r in enumerate(rooms) if r >= lengths[i]]
        if fit:
            rooms[min(fit)[1]] -= lengths[i]
        else:
            rooms.append(1024 - lengths[i])
    used = np.bincount(at, lengths)
    assert len(used) == len(rooms) and sorted(1024 - used) == sorted(rooms) and used.max() <= 1024


def test_toxicity(spark):
    insult = ["grobzul", "grobzuk", "grobzum", "fieswort"]
    rows, labels = [], []
    for i in range(600):
        text = prose(60).split()
        toxic = i % 5 == 0
        if toxic:
            for k in range(3):
                text[int(RNG.integers(60))] = insult[int(RNG.integers(4))]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "x"), (3, rows[3][1])]
    labels += [(None, 1), (5000, None)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(df, lab).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    right = sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) / len(held)
    assert right > 0.95
    assert next(r for r in got if r["doc_id"] == 1000)["predicted"] == 0
    assert toxicity.score(df.limit(0), lab).count() == 0
    alone = toxicity.score(df, lab.filter("toxic = 0")).select("score").distinct().collect()
    assert len(alone) == 1 and alone[0]["score"] < 0.05


def plain_log_likelihood(counts, word, order=6, mark=0.75, class_mark=4.0):
    """Of a word under both classes, from {word: (ordinary, toxic)}, by dictionaries of n-grams."""
    seen = {}
    for w, c in counts.items():
        x = b"\1" + w + b"\2"
        for e in range(1, len(x)):
            for n in range(1, min(order, e + 1) + 1):
                own = seen.setdefault(x[e - n + 1 : e + 1], [0, 0])
                own[0] += c[0]
                own[1] += c[1]
    before = Counter(g[1:] for g in seen)
    weight = {g: (*c, sum(c)) if len(g) == order or g[0] == 1 else (0, 0, before[g]) for g, c in seen.items()}
    weight = {g: (*((c[0], c[1]) if len(g) == order or g[0] == 1 else (0, 0)), c[2]) for g, c in weight.items()}

    def share(g, i, less, lower):
        after = [c[i] for h, c in weight.items() if h[:-1] == g[:-1]]
        if not sum(after):
            return lower
        freed = sum(after) - sum(max(a - less, 0) for a in after)
        return (max(weight.get(g, (0, 0, 0))[i] - less, 0) + freed * lower) / sum(after)

    x, out = b"\1" + word + b"\2", [0.0, 0.0]
    for e in range(1, len(x)):
        shared = 1 / 256
        for n in range(1, min(order, e + 1) + 1):
            g = x[e - n + 1 : e + 1]
            shared = share(g, 2, mark, shared)
        for c in (0, 1):
            out[c] += math.log(share(g, c, class_mark, shared))
    return out


def test_kneser_ney_by_dictionaries():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 10))).encode() for _ in range(40)]
    words = sorted(set(words))
    counts = {w: tuple(map(int, rng.integers(0, 12, 2))) for w in words}
    model = toxicity.Model(words, np.array([counts[w] for w in words]))
    asked = [*words, b"zzz", b"ab", b"abcabcabcabc", b""]
    assert model(asked) == pytest.approx(np.array([plain_log_likelihood(counts, w) for w in asked]), rel=1e-5)


def test_words_after_words():
    words = [b"bad", b"day", b"dog"]
    alone = np.array([[50, 5], [40, 40], [30, 30]])
    pairs, own, totals = [b"bad day", b"bad dog"], np.array([[20, 1], [2, 12]]), np.array([[30, 20], [30, 20]])
    model = toxicity.Model(words, alone, pairs, own, totals)
    reader = toxicity.Reader(model)
    got = reader.features([b"day bad dog", b"dog. bad", b"", b"bad day", b"dog"])
    one = model([b"day", b"bad", b"dog"])
    less = np.maximum(own - 4.0, 0)
    free = totals[0] - less.sum(0)
    for row, k, w in ((0, 1, 2), (3, 0, 0)):
        after = np.log((less[k] + free * np.exp(one[w])) / totals[0])
        gain = (after[1] - after[0]) - (one[w, 1] - one[w, 0])
        assert got[row, 7] == pytest.approx(max(gain, 0), rel=1e-6)
        rest = one[:2].sum(0) if row == 0 else one[1]
        assert got[row, 6] == pytest.approx(np.diff(rest + after)[0] / (3 if row == 0 else 2), rel=1e-6)
    assert (got[1, 6], got[1, 7]) == (pytest.approx(got[1, 1]), 0) and got[2].tolist() == [1] + [0] * 7
    assert got[0, 7] > 0 and got[3, 7] == 0


def test_toxicity_columns(spark):
    rows = [(i, "good fine words here" if i % 3 else "awful rotten words here", "a", 2.0, 1) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double, predicted int")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] * 2 + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.score(df, lab, keep=("text",))
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.columns[4:] == ["text"] and got.count() == 300


def test_toxicity_keeps_all_counts():
    assert (toxicity.MOST_TOXIC, toxicity.MOST_ORDINARY) == (3000, 5000)
    words = [b"abcdefgh", b"abcxyz"]
    model = toxicity.Model(words, np.array([[1, 0], [0, 1]]))
    for gram in toxicity.grams(*toxicity.spelled(words)):
        used = gram[(gram > 0) & (toxicity.spelled(words)[0] != toxicity.BEGIN)]
        assert np.isin(used, model.key).all() and np.isin(toxicity._history(used), model.history).all()


def test_toxicity_scores_at_the_labels_own_share(spark, monkeypatch):
    df = spark.createDataFrame([(i, prose(20)) for i in range(600)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(600)], "doc_id long, toxic int")  # the texts tell nothing
    monkeypatch.setattr(toxicity, "MOST_ORDINARY", 40)
    assert abs(toxicity.score(df, lab).agg(F.median("score")).first()[0] - 0.1) < 0.1


def test_suffix_arrays(spark):
    texts = [b"", b"a", b"aaaa", b"banana", b"mississippi", b"ab" * 50, b"aab" * 40 + b"aa", bytes(RNG.integers(0, 256, 300, np.uint8)), bytes(RNG.integers(97, 99, 200, np.uint8))]
    texts += [bytes(RNG.integers(97, 99, n, np.uint8)) for n in range(1, 40)]
    df = spark.createDataFrame([(i, bytearray(suffix_array.request_order(t))) for i, t in enumerate(texts)], "i int, r binary")
    for r in df.select("i", suffix_array.grouped(spark, F.col("r")).alias("o")).collect():
        t = texts[r["i"]]
        assert np.frombuffer(r["o"], "<i4").tolist() == sorted(range(len(t)), key=lambda k: t[k:])


def removed(rows):
    seen: dict = {}
    for k, t in rows:
        b = (t or "").encode()
        if k is not None:
            for i in range(len(b) - 49):
                s = b[i : i + 50]
                seen[s] = min(seen.get(s, k), k)
    out = Counter()
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if k is not None:
            for i in range(len(b) - 49):
                if seen[b[i : i + 50]] < k:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[k, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats(spark, docs, none):
    rows = [(k, t) for k, t, _ in ROWS]
    passage = prose(30)
    more = [(2000 + i, prose(int(RNG.integers(0, 9))) + passage[int(RNG.integers(0, 60)) : 100 + int(RNG.integers(0, 60))] + prose(6)) for i in range(40)] + [(1, "other " + passage)]
    df = docs.select("doc_id", "text", "size").union(spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, size int")).repartition(4)
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_row(suffix_dedup.remove_repeats(df), *columns) == removed(rows + more)
    assert suffix_dedup.remove_repeats(none).count() == 0
    texts = suffix_dedup.remove_repeats(df, text_out=True).filter("doc_id = 2").first()
    assert texts["kept_text"] == ""


def test_rooms_are_those_of_spark(spark):
    keys = [0, 1, -1, 5, 2**62, -(2**63), 211, 422]
    want = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(F.pmod(F.xxhash64("k"), F.lit(211))).collect()]
    assert suffix_dedup._room(np.array(keys, np.int64), 211).tolist() == want


def test_repeats_of_many_equal_keys(spark):
    rows = [(None, BASE)] * 40 + [(3, BASE)] * 40 + [(4 * i, BASE + f" {i}") for i in range(1, 40)] + [(2, "x " + BASE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(suffix_dedup.remove_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows)
