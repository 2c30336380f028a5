"""Mixing sources to target weights under a time-varying curriculum, in DataFrame expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Factor on a source's weight at the start and at the end of training, linear in between, by source rank, repeating.
#: Each pair averages 1, so integrated over the training the weights are those of WEIGHTS.
SCHEDULE = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
ROWS_A_BUCKET = 100_000


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple[float, ...], schedule: tuple[tuple[float, float], ...]) -> DataFrame:
    """Words each source gives: ``source, source_size, target, early, late``.

    The targets are weight * level, at most cap * size, with the one level at which they sum to share * all sizes; that
    is where repeated resharing of the excess ends. Sources sorted by cap * size / weight are full up to a point, so
    running sums find it. The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("rank") % len(xs) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("w", pick([float(x) for x in weights])).withColumn("full", F.col("source_size") * F.lit(float(cap)))
    per = per.withColumn("early", pick([float(a) for a, _ in schedule])).withColumn("late", pick([float(b) for _, b in schedule]))
    every = Window.partitionBy()
    by_fill = Window.orderBy(F.col("full") / F.col("w"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    w_rest = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("is_full", F.col("full") * w_rest <= rest * F.col("w")).withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
    free = F.col("total") - F.sum(F.when(F.col("is_full"), F.col("full")).otherwise(0.0)).over(every)
    w_free = F.sum(F.when(~F.col("is_full"), F.col("w")).otherwise(0.0)).over(every)
    target = F.when(F.col("is_full"), F.col("full")).otherwise(F.col("w") * free / w_free)
    return per.select("source", "source_size", target.alias("target"), "early", "late")


def _time(u: Column, early: Column, late: Column) -> Column:
    """The time at which a source whose weight runs linearly from early to late has met the part u of its demand."""
    area = u * (early + late) / 2.0
    root = F.sqrt(early * early + F.lit(2.0) * (late - early) * area)
    return F.when(area <= 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * area / (early + root)))


def curriculum_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, schedule: tuple[tuple[float, float], ...] = SCHEDULE, scratch: Scratch | None = None) -> DataFrame:
    """Mix documents so that each source gives its target of words, and say when in training each comes.

    Takes ``doc_id, text, source``; other columns are ignored. Returns, sorted by position, one row for each input row:
    ``doc_id, size, source_size, target, taken, position, again``. ``size`` counts words (a null text: 0). A source's
    documents stand in the order of md5 of their id, end to end, and the source's demand runs along them, over again
    after the last; what the demand reaches is taken, the last document in part, so the words taken sum to the rounded
    target and none exceeds ceil(cap) times its size. ``position`` (0 to 1) inverts the source's integrated weight
    schedule at the words before the document; ``again`` is the position of the second pass, null if the mix doesn't
    reach it; both are null where nothing is taken. A null source is a source, last in rank; a null id sorts as ''.
    Ties of equal id and size get interchangeable rows; an empty table gives no rows.

    Scale: texts are read once, for their word counts. The running sum over a source is cut into buckets of the order
    key whose number follows the row count (sums by bucket, then a window in each), so a source with a third of all
    rows is spread like any other; only one row for each source and bucket meets in a window.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key")), "sizes")
    n = max(16, math.ceil(sizes.count() / ROWS_A_BUCKET))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * n / F.lit(2**32)).cast("int")
    sizes = sizes.withColumn("bucket", bucket)
    per = source_targets(sizes, share, cap, weights, schedule)
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    lead = sums.withColumn("lead", F.coalesce(F.sum("words").over(w), F.lit(0))).drop("words")
    per = per.withColumnRenamed("source", "of")
    lead = lead.withColumnRenamed("source", "src").withColumnRenamed("bucket", "part")
    lead = lead.join(per, F.col("src").eqNullSafe(F.col("of")))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.withColumn("in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("part"))
    at = at.join(lead, on).withColumn("before", F.col("lead") + F.col("in"))
    want = F.round("target").cast("long")
    take = [F.greatest(F.lit(0), F.least(F.col("size"), want - F.lit(p) * F.col("source_size") - F.col("before"))) for p in range(math.ceil(cap))]
    start = [F.when(t > 0, F.round(_time((F.lit(p) * F.col("source_size") + F.col("before")) / want, F.col("early"), F.col("late")), 9)) for p, t in enumerate(take)]
    again = start[1] if len(start) > 1 else F.lit(None).cast("double")
    out = at.select("doc_id", "size", "source_size", "target", sum(take[1:], take[0]).alias("taken"), start[0].alias("position"), again.alias("again"))
    return out.orderBy("position", "doc_id")


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s GROUP BY source),
q AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][CAST(rank % 3 AS INT) + 1] AS w, source_size * 2.0::DOUBLE AS capped,
             [1.5::DOUBLE, 0.5, 1.0][CAST(rank % 3 AS INT) + 1] AS early, [0.5::DOUBLE, 1.5, 1.0][CAST(rank % 3 AS INT) + 1] AS late,
             CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM p),
r AS (SELECT *, capped * (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) <= (total - coalesce(sum(capped) OVER b, 0)) * w AS is_full
      FROM q WINDOW b AS (ORDER BY capped / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, early, late, CASE WHEN is_full THEN capped ELSE w * (total - sum(CASE WHEN is_full THEN capped ELSE 0 END) OVER ())
      / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () END AS target FROM r),
d AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.early, t.late, CAST(round(t.target) AS BIGINT) AS want,
             CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(size, want - before)) AS t0, greatest(0, least(size, want - source_size - before)) AS t1,
             before / want * (early + late) / 2.0 AS a0, (source_size + before) / want * (early + late) / 2.0 AS a1 FROM d)
SELECT doc_id, size, source_size, target, CAST(t0 + t1 AS BIGINT) AS taken,
       CASE WHEN t0 > 0 THEN round(CASE WHEN a0 <= 0 THEN 0.0 ELSE least(1.0, 2.0 * a0 / (early + sqrt(early * early + 2.0 * (late - early) * a0))) END, 9) END AS position,
       CASE WHEN t1 > 0 THEN round(CASE WHEN a1 <= 0 THEN 0.0 ELSE least(1.0, 2.0 * a1 / (early + sqrt(early * early + 2.0 * (late - early) * a1))) END, 9) END AS again
FROM e
"""
