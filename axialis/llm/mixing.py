"""Mixing sources to target weights along a curriculum.

Each source's sampling weight changes over training time t in 0..1 as a line of its own, from w*(1+slope) to
w*(1-slope), so the shares of the sources vary with time; its integral over time is the source's target of words.
Every copy taken has a place on its source's axis of cumulative demand: the words that the source has given before
it (first all documents once, then again), over its target. The place is inverted through the integral (a
quadratic, in closed form) to the time at which the source has used up those words, and copies are range-sorted by
that time.

Targets share `share` of all words by weight; none passes `cap` times its source's size, the excess is shared
anew by weight (water-filling, in closed form over the sources ordered by size/weight). Cumulative sums are
two-level: totals of (source, hash bucket), then rows inside a bucket, so that one large source is spread over
many tasks; the number of buckets follows the number of rows. The table of sources, one row each, is ordered in one
task: sources are corpora, not hosts or addresses.

Defined cases: a null text has size 0; a null source is a source of its own, the last; a source without words has a
target of 0 and isn't taken; rows are ordered within a source by md5 of doc_id and text, and equal rows take
consecutive places; an empty table gives an empty result; columns of any name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
SLOPES = (0.5, 0.0, -0.5)
ROWS_A_BUCKET = 20_000


def word_count(text: str = "text") -> Column:
    r"""Number of maximal runs outside of space and \x09-\x0D, null: 0."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = F.translate(t, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " +"), "")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """From (source, size): source, source_size, weight, slope, target. One row a source; weights and slopes are dealt
    to the sources in order, in turns."""
    if any(abs(x) > 1 for x in slopes):
        raise ValueError("slopes are from -1 to 1")
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = total.withColumn("turn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    dealt = lambda values: F.element_at(F.array(*[F.lit(float(x)) for x in values]), (F.col("turn") % len(values) + 1).cast("int"))
    total = total.withColumns({"weight": dealt(weights), "slope": dealt(slopes), "most": F.lit(cap) * F.col("source_size")})
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    total = total.withColumn("level", level).withColumn("free", F.col("most") / F.col("weight") > F.col("level"))
    flat = F.max(F.when(F.col("free"), F.col("level"))).over(every)
    target = F.least(F.col("most"), F.coalesce(flat * F.col("weight"), F.col("most")))
    return total.select("source", "source_size", "weight", "slope", target.alias("target"))


def time_of(demand: Column, slope: Column) -> Column:
    """The time in 0..1 at which a line from 1 + slope to 1 - slope, -1 to 1, has the integral `demand`."""
    b = F.lit(1.0) + slope
    root = F.sqrt(F.greatest(b * b - F.lit(4.0) * slope * demand, F.lit(0.0)))
    return F.when(demand > 0, F.lit(2.0) * demand / (b + root)).otherwise(F.lit(0.0))


def sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """row (the columns asked for), src, size and key (the order within a source) of each document."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    return docs.select(row.alias("row"), F.col("source").alias("src"), word_count().alias("size"), key.alias("key"))


def placed(rows: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = 1.5, cap: float = 2.0, rows_a_bucket: int = ROWS_A_BUCKET) -> DataFrame:
    """The rows of `sized` with source_size, target, copies and positions: the training time of each copy.

    A source with target/size = k + f takes every document k times and, of its documents in hash order, those
    whose middle lies below the fraction f of its words once more."""
    n = rows.count()
    digits = 1
    while 16**digits * rows_a_bucket < n:
        digits += 1
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    parts = rows.groupBy("src", "bucket").agg(F.sum("size").alias("size"))
    goal = source_targets(parts.select(F.col("src").alias("source"), "size"), weights, slopes, share, cap)
    running = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    parts = parts.join(goal, F.col("src").eqNullSafe(F.col("source"))).select(F.col("src").alias("own"), F.col("bucket").alias("part"), "before", "source_size", "slope", "target")
    inside = Window.partitionBy("src", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(parts, F.col("src").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("part")))
    start = F.col("before") + F.col("within")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    more = (2 * start + F.col("size")) < 2 * (ratio - whole) * F.col("source_size")
    rows = rows.select("row", "key", "size", "source_size", "target", "slope", start.alias("start"), (whole + more.cast("long")).cast("long").alias("copies"))

    def position(copy):
        given = (copy - 1) * F.col("source_size") + F.col("start")
        return time_of(F.least(given / F.col("target"), F.lit(1.0)), F.col("slope"))

    times = F.transform(F.sequence(F.lit(1), F.greatest(F.col("copies"), F.lit(1)).cast("int")), position)
    return rows.withColumn("positions", F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>")))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, positions (the training time of each copy), range-sorted by the first."""
    rows = placed(stored(sized(docs, ["doc_id"]), "sizes"), **how)
    out = rows.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "positions")
    return out.orderBy(F.try_element_at("positions", F.lit(1)).asc_nulls_last(), "doc_id")


def mix_rows(docs: DataFrame, slopes=SLOPES, **how) -> DataFrame:
    """The documents taken, each as many times as the mix takes it, range-sorted by the training time of each copy."""
    rows = placed(sized(docs, docs.columns), slopes=slopes, **how)
    rows = rows.select("row", "key", F.posexplode("positions").alias("copy", "time"))
    return rows.orderBy("time", "key", "copy").select("row.*")


# Every copy's time is found by bisection on the integral of its source's weight (trapezoids, exact for a line).
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0e0, 2.0e0, 1.0e0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS weight,
             [0.5e0, 0.0e0, -0.5e0][((row_number() OVER (ORDER BY source ASC NULLS LAST)) - 1) % 3 + 1] AS slope,
             2.0e0 * source_size AS most FROM s),
l AS (SELECT *, (1.5e0 * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, slope, least(most, coalesce(max(CASE WHEN most / weight > level THEN level END) OVER () * weight, most)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, d.k, row_number() OVER () AS rid,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(ratio) + CASE WHEN 2 * start + size < 2 * (ratio - floor(ratio)) * source_size THEN 1 ELSE 0 END)::BIGINT AS copies FROM r),
g AS (SELECT rid, copy, slope, target, (copy - 1) * source_size + start AS words FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM c)),
b AS (SELECT rid, copy, slope, target, words, 0.0e0 AS lo, 1.0e0 AS hi, 0 AS step FROM g
      UNION ALL
      SELECT rid, copy, slope, target, words, CASE WHEN under THEN mid ELSE lo END, CASE WHEN under THEN hi ELSE mid END, step + 1
      FROM (SELECT *, (lo + hi) / 2 AS mid, target * (lo + hi) / 2 * ((1 + slope) + (1 + slope * (1 - (lo + hi)))) / 2 <= words AS under
            FROM b WHERE step < 52)),
p AS (SELECT rid, max(CASE WHEN copy = 1 THEN lo END) AS p1, max(CASE WHEN copy = 2 THEN lo END) AS p2 FROM b WHERE step = 52 GROUP BY rid)
SELECT doc_id, size, source_size, round(target, 4) AS target, (copies * size)::BIGINT AS taken, copies,
       round(p1, 7) AS position, round(p2, 7) AS position_2
FROM c LEFT JOIN p ON c.rid = p.rid
"""
