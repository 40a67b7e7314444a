"""Mixing sources to target weights.

Sizes are summed by source, targets follow from weights under a cap, and each
document is taken floor(rate) times plus one Bernoulli copy whose coin is a
hash of its id, so that reruns and other partitionings agree. A further column (the
language, say) may cut sources into parts that share their target: small parts get
more than in proportion to their size, the source as much as without.

Nulls: a null text has size 0; a null source is a source of its own and sorts
last, a null part is a part of its own; a null id is hashed as such. Empty tables
give empty results. Repeated rows share their coin. Very long texts are counted
whole; ties between sources go by their order. Extra columns, whatever their names, are kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.snapshots import ranked
from .common import discard, stage_table, unit_hash

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the table of sources up to which it is broadcast; above, it is joined by a salted key.
BROADCAST_SOURCES = 50_000
SALTS = 64


def word_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Targets are shared by weight; what exceeds ``cap`` times a source's size is shared anew among the rest. The
    fixed point is ``min(cap * size, level * weight)``. Sources are numbered in ranges that span tasks, and the level is
    found by one-row sums, so that there may be any number of sources.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by = ranked(by.select(F.lit(0).alias("all"), F.isnull("source").alias("last"), "source", "source_size"), "all", ["last", "source"], "place")
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    by = by.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("meets", F.col("most") / F.col("weight"))
    by = stage_table(by.select("source", "source_size", "weight", "most", "meets"), "sources")
    level = F.lit(_level(by, share)).cast("double")
    return by.select("source", "source_size", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def _level(sources: DataFrame, share: float) -> float | None:
    """What a unit of weight gets where sources that meet their caps get those; none if all of them do.

    Each round shares what the full sources leave among the others, which only raises the level and fills more of them.
    """
    level, before = 0.0, -1
    while True:
        full = (F.col("meets") < level) if before >= 0 else F.lit(False)
        n, total, most, open_ = sources.agg(F.count_if(full), F.sum("source_size"), F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n <= before or not open_:
            return level if open_ else None
        level, before = (share * total - most) / open_, n


def parts(sources: DataFrame, sizes: DataFrame, power: float = 0.7, cap: float = 2.0) -> DataFrame:
    """(source, part, source_size, target) with each part's own size and target, from (source, target) and (source, part, size), a row a part.

    A source's target is shared by its parts' sizes to the ``power``; what exceeds ``cap`` times a part's size is shared anew among
    the others, so that the parts' targets add up to their source's. The parts of a source are one task's, a short row each.
    """
    by = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(power)))).withColumn("most", F.lit(float(cap)) * F.col("size"))
    by = by.withColumn("meets", F.coalesce(F.try_divide("most", "weight"), F.lit(0.0)))
    by = by.join(sources.select(F.col("source").alias("of"), F.col("target").alias("all")), F.col("source").eqNullSafe(F.col("of")))
    # what a unit of weight gets if the parts that fill up before this one are full and no others; the level is the largest of these
    filled = Window.partitionBy("source").orderBy("meets", "part").rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy(F.desc("meets"), F.desc("part")).rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("level", F.try_divide(F.col("all") - F.coalesce(F.sum("most").over(filled), F.lit(0.0)), F.sum("weight").over(others)))
    level = F.max("level").over(Window.partitionBy("source"))
    return by.select("source", "part", F.col("size").alias("source_size"), F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def own_names(docs: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores in front as make them differ from every column of ``docs``."""
    taken, mark = {c.lower() for c in docs.columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def with_copies(
    docs: DataFrame, copies: str, size_col: str, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source",
    part_col: str | None = None, power: float = 0.7,
) -> tuple[DataFrame, str, str]:
    """``docs`` (with its sizes) plus ``copies``, and the names of two columns more: its source's size and target, or those of its part by ``part_col``. A hot source is never gathered in one task."""
    of, size, target, salt, at, part = own_names(docs, "source", "source_size", "target", "salt", "at", "part")
    sizes = docs.select(F.col(source_col).alias("source"), *([] if part_col is None else [F.col(part_col).alias("part")]), F.col(size_col).alias("size"))
    if part_col is None:
        per = stage_table(targets(sizes, weights, share, cap), "targets")
    else:
        sizes = stage_table(sizes.groupBy("source", "part").agg(F.sum("size").cast("long").alias("size")), "parts")
        per = stage_table(parts(targets(sizes, weights, share, cap), sizes, power, cap), "targets")
        discard(sizes)
    per = per.withColumnsRenamed({"source": of, "source_size": size, "target": target, "part": part})
    same = docs[source_col].eqNullSafe(per[of])
    if part_col is not None:
        same &= docs[part_col].eqNullSafe(per[part])
    if per.count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(per), same)
    else:
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(id_col), F.lit(SALTS)))
        spread = per.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn(at, F.col(at).cast("long"))
        # the rows that the salts make aren't in Spark's estimate of the size, by which it would broadcast them
        joined = salted.join(spread.hint("merge"), same & (salted[salt] == spread[at])).drop(salt, at)
    rate = F.coalesce(F.try_divide(F.col(target), F.col(size).cast("double")), F.lit(0.0))
    extra = unit_hash(F.col(id_col), seed=seed) < rate - F.floor(rate)
    return joined.withColumn(copies, (F.floor(rate) + extra.cast("long")).cast("long")).drop(of, part), size, target


def mix(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The mixture itself: each document of ``docs`` as often as it is taken, with its own columns only."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    words, copies, copy = own_names(docs, "words", "copies", "copy")
    out = with_copies(docs.withColumn(words, word_size(F.col(text_col))), copies, words, **how)[0]
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))).select(*cols)


def mixture_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: how much the mixture takes of each document."""
    sized = stage_table(docs.select("doc_id", "source", word_size(F.col("text")).alias("size")), "sizes")
    out, source_size, target = with_copies(sized, "copies", "size", **how)
    return out.select("doc_id", "size", F.col(source_size).alias("source_size"), F.col(target).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


REPORT_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM by_source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS most FROM placed
), filled AS (
  SELECT *, most / weight AS meets, row_number() OVER (ORDER BY most / weight, place) AS nth,
    1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open
  FROM weighed
), level AS (
  SELECT min_by(remaining / open, nth) AS level FROM filled WHERE remaining / open <= meets
), targets AS (
  SELECT source, source_size, least(most, coalesce(level * weight, most)) AS target FROM filled CROSS JOIN level
), rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0)::DOUBLE, 0) AS rate,
    ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '~') || ':mix'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS coin
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * (floor(rate) + (coin < rate - floor(rate))::INT)::BIGINT AS taken FROM rated
"""
