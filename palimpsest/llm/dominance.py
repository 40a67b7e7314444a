"""Dominance counting: for every row, the rows of an earlier slot with a strictly larger level.

Rows of one slot and level form a cell, counted and weighed before anything is
dealt. A level is cut into digits of ``DIGIT_BITS`` bits. Of two different
levels the larger one has the larger digit at the first place in which they
differ, where all digits above agree; so every pair is counted at exactly one
digit, among cells of an equal prefix.

All digits are swept at once: cells, one row a digit, are dealt by ranges of
(digit place, prefix, slot, level), whatever the size of a prefix' group, and
sorted. Within a task an array of 256 counts by digit goes along; blocks of
rows take what lies before them from its sums, and what lies within them from
comparisons among their own. As cells of one slot stand by rising level, none
of them counts for another. A group that spans tasks hands on its counts: each
task leaves the counts of its last group, and running sums by (group, digit)
and then by task give what the rows of its first group still lack. Nothing but
those 256 counts a task is gathered, and no task gets more than its range.

Rows with a null slot or level are above none and get null counts; without any
other row nothing is counted. A null weight, as of a null sale_id, is 1. Equal rows count once each. An empty table gives
an empty result. Other columns are kept whatever their names, but for those of
the result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table, trim

DIGIT_BITS = 8
DIGITS = 1 << DIGIT_BITS
#: Rows that are compared among themselves.
BLOCK = 128
#: A swept row, a place to take handed-on counts, counts handed on; in this order at one task.
ROW, ASK, TELL = 0, 1, 2
_SWEPT = "kind byte, task int, place int, prefix long, digit int, slot long, key long, n long, w long, head boolean"


class Sweep:
    """Rows in order (group, slot, level), in batches: how many before each, of its group, have a larger digit."""

    def __init__(self) -> None:
        self.counts = np.zeros((2, DIGITS), np.int64)
        self.group: tuple[int, int] | None = None

    def step(self, place: np.ndarray, prefix: np.ndarray, digit: np.ndarray, n: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(2 x rows counts, the number of each row's group: 0 goes on from the batch before)."""
        new = np.r_[self.group != (int(place[0]), int(prefix[0])), (place[1:] != place[:-1]) | (prefix[1:] != prefix[:-1])]
        group = np.cumsum(new)
        both = np.stack([n, w])
        out = np.zeros(both.shape, np.int64)
        earlier = np.tri(BLOCK, k=-1, dtype=bool)
        held = 0  # the group that the counts are of
        for i in range(0, len(digit), BLOCK):
            at = slice(i, i + BLOCK)
            g, d, x = group[at], digit[at], both[:, at]
            k = len(g)
            above = earlier[:k, :k] & (d > d[:, None]) & (g == g[:, None])
            out[:, at] = (x.astype(np.float64) @ above.T).astype(np.int64)  # sums in a block stay far below 2^53
            going = int(np.searchsorted(g, held, "right")) if g[0] == held else 0
            if going:
                larger = self.counts.sum(1, keepdims=True) - np.cumsum(self.counts, 1)
                out[:, i : i + going] += larger[:, d[:going]]
            first = int(np.searchsorted(g, g[-1]))
            if g[-1] != held:
                self.counts[:] = 0
                held = int(g[-1])
            for row in (0, 1):
                np.add.at(self.counts[row], d[first:], x[row, first:])
        self.group = (int(place[-1]), int(prefix[-1]))
        return out, group


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, sweep, first = TaskContext.get().partitionId(), Sweep(), None

    def made(kind, place, prefix, digit, slot, key, n, w, head) -> pa.RecordBatch:
        size = len(digit)
        whole = lambda v, t: pa.array(np.full(size, v, t))
        return pa.RecordBatch.from_arrays(
            [whole(kind, np.int8), whole(task, np.int32), *map(pa.array, (place, prefix, digit, slot, key, n, w, head))],
            ["kind", "task", "place", "prefix", "digit", "slot", "key", "n", "w", "head"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        place, prefix, digit, slot, key, n, w = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("place", "prefix", "digit", "slot", "key", "n", "w"))
        (above, weight), _ = sweep.step(place, prefix, digit, n, w)
        if first is None:
            first = (place[0], prefix[0])
        head = (place == first[0]) & (prefix == first[1])
        some = head | (above > 0)
        yield made(ROW, place[some], prefix[some], digit[some], slot[some], key[some], above[some], weight[some], head[some])
    if first is not None:
        every, none = np.arange(DIGITS, dtype=np.int32), np.zeros(DIGITS, np.int64)
        ends = ((ASK, first, none, none), (TELL, sweep.group, *sweep.counts))
        for kind, (place, prefix), n, w in ends:
            yield made(kind, np.full(DIGITS, place, np.int32), np.full(DIGITS, prefix, np.int64), every, none, none, n, w, np.zeros(DIGITS, bool))
    trim()


def _digits(cells: DataFrame, bits: int) -> DataFrame:
    """A row for every cell (slot, key, n, w) and digit place; the first place is the lowest."""
    places = -(-bits // DIGIT_BITS)
    rows = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("place"))
    above = F.expr(f"CASE WHEN place = {places - 1} THEN 0L ELSE shiftrightunsigned(key, {DIGIT_BITS} * (place + 1)) END")
    return rows.select("place", above.alias("prefix"), F.expr(f"CAST(shiftrightunsigned(key, {DIGIT_BITS} * place) & {DIGITS - 1} AS INT)").alias("digit"), "slot", "key", "n", "w")


def _counted(cells: DataFrame, bits: int) -> DataFrame:
    """(slot, key, n, w): what lies above each cell; cells with nothing above them are missing."""
    # keys of 64 bits are unsigned numbers: they rise as what they were made of
    order = [F.col("place"), F.col("prefix"), F.col("slot"), F.col("key") if bits < 64 else F.col("key").bitwiseXOR(F.lit(-(1 << 63)))]
    dealt = _digits(cells, bits).repartitionByRange(*order).sortWithinPartitions(*order)
    swept = stage_table(dealt.mapInArrow(_swept, _SWEPT), "swept")
    before = Window.partitionBy("place", "prefix", "digit").orderBy("task", "kind").rowsBetween(Window.unboundedPreceding, -1)
    asked = swept.filter(f"kind > {ROW}").select("kind", "task", "digit", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n", "w")]).filter(f"kind = {ASK}")
    larger = Window.partitionBy("task").orderBy(F.desc("digit")).rowsBetween(Window.unboundedPreceding, -1)
    lacking = asked.select("task", "digit", *[F.sum(c).over(larger).alias(f"_{c}") for c in ("n", "w")]).filter("_n > 0")
    rows = swept.filter(f"kind = {ROW}")
    # they grow with the tasks, so that they are never broadcast
    handed = rows.filter("head").join(lacking.hint("merge"), ["task", "digit"]).select("slot", "key", F.col("_n").alias("n"), F.col("_w").alias("w"))
    return rows.filter("n > 0").select("slot", "key", "n", "w").unionByName(handed).groupBy("slot", "key").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))


def dominating(rows: DataFrame, slot: Column, level: Column, weight: Column | None = None, names: tuple[str, str] = ("n_above", "w_above")) -> DataFrame:
    """``rows`` with two columns: how many rows have a smaller ``slot`` and a larger ``level`` (both long), and the sum of their weights (long, 1 if none is given)."""
    kept = [c for c in rows.columns if c not in names]
    held = rows.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(kept)], slot.cast("long").alias("_slot"), level.cast("long").alias("_level"), F.coalesce(F.lit(1) if weight is None else weight, F.lit(1)).cast("long").alias("_weight"))
    full = held.filter("_slot IS NOT NULL AND _level IS NOT NULL")
    low, high = full.agg(F.min("_level"), F.max("_level")).first()
    back = [F.col(f"_in{i}").alias(c) for i, c in enumerate(kept)]
    if low is None:
        return held.select(*back, *[F.lit(None).cast("long").alias(c) for c in names])
    # from 0 on where the range is a long, else with the order of unsigned numbers
    narrow = high - low < 1 << 63
    key = F.col("_level") - F.lit(low) if narrow else F.col("_level").bitwiseXOR(F.lit(-(1 << 63)))
    bits = max(1, (high - low).bit_length()) if narrow else 64
    cells = full.groupBy(F.col("_slot").alias("slot"), key.alias("key")).agg(F.count("*").alias("n"), F.sum("_weight").alias("w"))
    found = _counted(cells, bits).select(F.col("slot").alias("_slot"), F.col("key").alias("_key"), "n", "w")
    out = held.withColumn("_key", key).join(found, ["_slot", "_key"], "left")
    known = F.col("_slot").isNotNull() & F.col("_level").isNotNull()
    return out.select(*back, *[F.when(known, F.coalesce(F.col(c), F.lit(0))).alias(name) for c, name in zip(("n", "w"), names, strict=True)])


def minutes(ts: str, kind: str) -> Column:
    """Whole minutes since 1970 of a timestamp, which without a zone is taken as UTC whatever the session's zone."""
    if kind == "timestamp":
        return F.floor(F.unix_seconds(ts) / 60)
    return F.date_diff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def hundredths(value: str, step: int = 1) -> Column:
    """A value in hundredths, rounded half up, in steps; null if it is null, not finite or beyond a long."""
    x = F.floor(F.floor(100 * F.col(value).cast("double") + 0.5) / step)
    # floor gives a long itself: what isn't one is left out before
    return F.when(F.abs(F.col(value).cast("double")) < 9e16, x)


def sales_above(sales: DataFrame) -> DataFrame:
    """sale_id, slot, level, n_sales, n_rows of every sale; a sale weighs 1 to 5 by its id."""
    copies = 1 + F.crc32(F.col("sale_id").cast("string")) % 5
    rows = sales.select("sale_id", minutes("sold_at", dict(sales.dtypes)["sold_at"]).cast("long").alias("slot"), hundredths("total").alias("level"), copies.alias("_copies"))
    return dominating(rows, F.col("slot"), F.col("level"), F.col("_copies"), ("n_sales", "n_rows")).select("sale_id", "slot", "level", "n_sales", "n_rows")


_CRC = "xor(list_reduce(list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda b, i: xor(b >> 1, 3988292384 * (b & 1)), xor(a, x)), 4294967295), 4294967295)"
SALES_SQL = f"""WITH s AS (SELECT sale_id, floor(epoch(date_trunc('second', sold_at)) / 60)::BIGINT AS slot, floor(100 * total + 0.5)::BIGINT AS level, 1 + {_CRC} % 5 AS copies FROM sales)
  , above AS (SELECT a.sale_id, count(*) AS n_sales, sum(b.copies)::BIGINT AS n_rows FROM s a JOIN s b ON b.slot < a.slot AND b.level > a.level GROUP BY a.sale_id)
  SELECT sale_id, slot, level, CASE WHEN slot IS NOT NULL AND level IS NOT NULL THEN coalesce(n_sales, 0) END AS n_sales, CASE WHEN slot IS NOT NULL AND level IS NOT NULL THEN coalesce(n_rows, 0) END AS n_rows
  FROM s LEFT JOIN above USING (sale_id)"""
