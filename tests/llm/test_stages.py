"""Pipeline stages against brute force on a small table with nulls, empty texts, copies and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import BASE, ROWS, by_row, components_of, prose, removed

import corpus_pipeline as c
from maxentnet.llm import toxicity
from maxentnet.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", s, len(t or "")) for k, t, s in ROWS if k != 12] + [(500 + i, f"{BASE} {prose(i)}", "de", None, 1) for i in range(6)]
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], SCHEMA + ", size string, score double").repartition(3).select(*c.COLUMNS, "size", "score")


def test_toxic_documents_go(spark, docs, tmp_path):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(1, 130)], "doc_id long, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    told = toxicity.score(docs.select("doc_id", "text"), labels)
    got = c.drop_toxic(spark, docs, str(tmp_path))
    assert got.columns == list(c.COLUMNS)
    by = {(r["doc_id"]): r["predicted"] for r in told.filter("doc_id <> 22").collect()}
    assert Counter(r["doc_id"] for r in got.filter("doc_id <> 22 AND doc_id IS NOT NULL").collect()) == Counter(k for k, p in by.items() if k is not None and not p)
    assert by_row(got.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").filter("NOT text <=> t"), "doc_id") == {}
    assert c.drop_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_one_document_of_a_group_stays(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    groups = {}
    for (k, n, least, _), _ in components_of([r for r in rows if r[0] is not None]).items():
        if k == least or not n:
            groups[k] = least
    got = c.drop_near_duplicates(spark, docs, "")
    assert Counter(r["doc_id"] for r in got.filter("doc_id IS NOT NULL").collect()) == Counter(groups.keys())
    nulls = {r["text"] for r in got.filter("doc_id IS NULL").collect()}
    assert nulls == {None}  # the other one is a copy of document 1


def test_passages_go(spark, docs):
    want = removed([(r["doc_id"], r["text"]) for r in docs.collect()])
    got = c.cut_repeats(spark, docs, "")
    assert got.columns == list(c.COLUMNS)
    left = {k: n - gone for k, n, gone, _, _ in want}
    for r in got.filter("doc_id IS NOT NULL").collect():
        assert 0 <= left[r["doc_id"]] - len(r["text"].encode()) <= 6  # but for characters that a cut goes through
    assert got.count() == docs.count()
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_the_mix_takes_words(spark, docs):
    taken = Counter()
    for r in c.mix_sources(spark, docs, "").collect():
        taken[r["source"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"] or "")
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        open_ -= set(over)
    assert all(taken[s] == int(target[s] + 1e-9) for s in order)


def test_windows_hold_all_tokens(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    want, windows = Counter(), {}
    for r in docs.collect():
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for s in range(0, len(ids), 1024):
            want[r["doc_id"], s, zlib.crc32(ids[s : s + 1024].tobytes())] += 1
    rows = c.pack_windows(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        ends = [0, *(o + n for o, n in sorted(own))]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024
