"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maxentnet.llm import _work

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a source that one window orders, about.
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text: places where such a character follows none. A null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, docs -> the same with target: ``share`` of all sizes dealt by weight, none above ``most`` times its source's size.

    Sources in code point order, null last, take the weights in turn. What is above a ceiling is dealt again by weight: with the
    sources sorted by ceiling over weight, the first k are at their ceiling and the rest share what these leave, for the least k
    that puts none above. Only this table of sources, not of documents, is put in one order.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    t = t.withColumn("ceiling", F.col("source_size") * F.lit(most))
    before = W.orderBy(F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    t = t.withColumns({
        "left": F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    free = F.col("ceiling") * F.col("open") > F.col("left") * F.col("weight")
    level = F.min(F.when(free, F.struct(F.col("ceiling") / F.col("weight"), F.col("source").isNull(), "source", "left", "open"))).over(everything)
    level = F.when(level.isNotNull(), level["left"] / level["open"])
    dealt = F.coalesce(F.least(F.col("ceiling"), level * F.col("weight")), F.col("ceiling"))
    return t.select("source", "source_size", "docs", dealt.alias("target"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, size, source_size, target, taken, source for every row, with the columns named in ``keep`` (as <name>_kept where a result has the name).

    Each row gets a hash-random key, of its key and text, so that null and repeated keys are spread too; a source's rows lie in order of it, and the words before each row are a prefix sum: ranges of
    the key are summed first, so that no window holds more than about BUCKET_ROWS rows however large a source is. A source whose
    target is e times its size and r words takes every row e times, and once more the rows that begin before r; the row across the
    cut gives only its words before it, so that taken adds up to the whole part of the target. The sources, not their rows, are put in
    one window to deal the targets: there may be some millions. A null text has size 0, a null source
    is a source of its own (last), a null key is a key like others. Repeated rows are interchangeable; the result is the same on
    each run. An empty table gives none.
    """
    own = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    spread = F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("long").alias("spread")
    result = (key, "size", "source_size", "target", "taken", "source")
    kept = {c: f"_keep{i}" for i, c in enumerate(keep)}
    rows = df.select(F.col(key).alias("_key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), spread, *(F.col(c).alias(k) for c, k in kept.items()))
    rows = _work.written(rows, "mix-sizes")
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    plan = targets(total, weights, share, most)
    plan = plan.withColumns({
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0).cast("long"),
        "ranges": F.ceil(F.col("docs") / BUCKET_ROWS).cast("long"),
    })
    plan = plan.withColumn("rest", (F.floor("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = _work.written(plan.withColumnRenamed("source", "of"), "mix-plan")
    # a range is a part of the 52-bit key's span, in order of the key
    placed = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("range", F.floor(F.col("spread") / F.lit(2.0**52) * F.col("ranges")).cast("long"))
    summed = placed.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = summed.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("in_range").over(earlier), F.lit(0)).alias("range_start"))
    inside = W.partitionBy("source", "range").orderBy("spread", F.col("_key").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    begin = F.col("range_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("rest") - F.col("begin"), F.col("size")))
    named = [F.col(k).alias(f"{c}_kept" if c in result else c) for c, k in kept.items()]
    return placed.withColumn("begin", begin).select(F.col("_key").alias(key), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source", *named)


#: The same rows in DuckDB's SQL.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 13))::BIGINT AS spread FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS ceiling FROM t),
l AS (SELECT *, sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(ceiling) OVER b, 0) AS "left", sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS "open"
      FROM w WINDOW b AS (ORDER BY ceiling / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT "left" / "open" AS level FROM l WHERE ceiling * "open" > "left" * weight ORDER BY ceiling / weight, source NULLS LAST LIMIT 1),
p AS (SELECT source, source_size, coalesce(least(ceiling, (SELECT level FROM v) * weight), ceiling) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END::BIGINT AS epochs FROM p),
r AS (SELECT d.*, source_size, target, epochs, floor(target)::BIGINT - epochs * source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY spread, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(rest - begin, size)))::BIGINT AS taken, source FROM r
"""
