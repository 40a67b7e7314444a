"""Average treatment effects by greedy one-to-one matching on one pooled, standardised confounder."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import discard, stage_table
from .eventlog import field, tombstones
from .snapshots import ranked

CALIPER = 0.5
#: Nodes of a range of scores, and how many ranges there are at most.
RANGE_ROWS, MOST_RANGES = 50_000, 4096
LEAST_GROUP = 3
OBSERVATIONAL, VALIDATED = 10, 30
#: Confounders that are tried when none is named.
CONFOUNDERS = ("size", "complexity", "priority", "effort", "weight")


def treated(conditions: dict, payload: str = "payload") -> Column:
    """Whether a payload meets all conditions, by value and JSON type; numbers compare as numbers, booleans as 0 and 1, null with what is missing."""
    out = F.lit(True)
    parsed = F.try_parse_json(payload)
    for key, value in conditions.items():
        path = f"$.{key}"
        kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        if value is None:
            out &= F.coalesce(kind == "VOID", F.lit(True))
        elif isinstance(value, (bool, int, float)):
            number = F.when(kind == "BOOLEAN", F.try_variant_get(parsed, path, "boolean").cast("double")).when(kind != "STRING", F.try_variant_get(parsed, path, "double"))
            out &= F.coalesce(number == float(value), F.lit(False))
        else:
            out &= F.coalesce((kind == "STRING") & (F.try_variant_get(parsed, path, "string") == str(value)), F.lit(False))
    return out


def confounder_of(nodes: DataFrame, candidates: tuple[str, ...] = CONFOUNDERS, payload: str = "payload") -> DataFrame:
    """(confounder): the first candidate that any node has; null if none."""
    parsed = F.try_parse_json(payload)
    has = nodes.agg(*[F.bool_or(F.try_variant_get(parsed, f"$.{c}", "variant").isNotNull()).alias(c) for c in candidates])
    return has.select(F.coalesce(*[F.when(F.col(c), F.lit(c)) for c in candidates]).alias("confounder"))


def split_counts(nodes: DataFrame) -> DataFrame:
    """(treatment_n, control_n, error) of nodes with ``treated``."""
    n = nodes.agg(F.count_if("treated").alias("treatment_n"), F.count_if(~F.col("treated")).alias("control_n"))
    return n.withColumn("error", F.when(F.least("treatment_n", "control_n") < LEAST_GROUP, "too few samples on one side"))


def standardised(nodes: DataFrame) -> DataFrame:
    """``nodes`` with score: the confounder less the pooled mean over the pooled population deviation; all 0 where that is nil."""
    value = F.coalesce("confounder", F.lit(0.0))
    pool = nodes.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))  # one row
    rows = nodes.crossJoin(F.broadcast(pool))
    return rows.withColumn("score", F.when(F.col("_std") < 1e-9, F.lit(0.0)).otherwise((value - F.col("_mean")) / F.col("_std"))).drop("_mean", "_std")


class FreeControls:
    """Controls of a range of scores: the nearest free one is found by a binary search.

    Controls of one score form a queue; empty queues are skipped by path-compressed links to both sides.
    """

    def __init__(self, controls: list[tuple[float, int]]):
        self.values = sorted({s for s, _ in controls})
        self.queues: dict[float, list[int]] = {v: [] for v in self.values}
        for s, i in sorted(controls, key=lambda c: -c[1]):
            self.queues[s].append(i)  # the earliest is at the end
        self.up, self.down, self.left = list(range(len(self.values) + 1)), list(range(len(self.values) + 1)), len(controls)

    @staticmethod
    def _find(link: list[int], k: int) -> int:
        while link[k] != k:
            link[k] = link[link[k]]
            k = link[k]
        return k

    def nearest(self, score: float, caliper: float) -> tuple[float, int, int] | None:
        """(distance, control, its place) of the nearest free control within the caliper, the earliest of equals."""
        at = bisect_left(self.values, score)
        right, left = self._find(self.up, at), self._find(self.down, at) - 1  # up: first filled at or after; down, shifted by one: last filled before
        options = [(abs(score - self.values[k]), self.queues[self.values[k]][-1], k) for k in (right, left) if 0 <= k < len(self.values)]
        return min(options) if options and min(options)[0] < caliper else None

    def take(self, k: int) -> None:
        self.queues[self.values[k]].pop()
        self.left -= 1
        if not self.queues[self.values[k]]:
            self.up[k], self.down[k + 1] = k + 1, k


def greedy(treatment: list[tuple[float, int]], control: list[tuple[float, int]], caliper: float = CALIPER) -> list[tuple[int, int]]:
    """Pairs (treatment, control): in order, each takes the nearest free control within the caliper, the earliest of equals."""
    free, pairs = FreeControls(control), []
    for score, t in treatment:
        if found := free.nearest(score, caliper):
            pairs.append((t, found[1]))
            free.take(found[2])
    return pairs


def _home(edges: np.ndarray, score: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, score, "right").astype(np.int32)


def _visits(seq: np.ndarray, score: np.ndarray, choice: np.ndarray, edges: np.ndarray, closed: np.ndarray, caliper: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, range): each treatment sees its own range, the one it chose, and the nearest on either side that was open when its turn came."""
    home = _home(edges, score)
    rows, ranges = [np.arange(len(seq))], [home]
    for h in np.unique(home):
        here = np.flatnonzero(home == h)
        for side, step in ((closed[:h][::-1], -1), (closed[h + 1 :], 1)):
            if not len(side):
                continue
            first = np.searchsorted(np.maximum.accumulate(side), seq[here])  # closing moments up to there: the first that isn't earlier
            far = first < len(side)
            to = h + step * (1 + first[far])
            border = edges[to] if step < 0 else edges[to - 1]
            near = np.abs(score[here][far] - border) <= caliper
            rows.append(here[far][near])
            ranges.append(to[near].astype(np.int32))
    chose = np.flatnonzero(choice >= 0)
    row, of = np.concatenate([*rows, chose]), np.concatenate([*ranges, choice[chose]])
    both = np.unique(np.stack([row, of]), axis=1)
    return both[0], both[1].astype(np.int32)


def _offers(batches: Iterator[pa.RecordBatch], caliper: float) -> Iterator[pa.RecordBatch]:
    """Ranges one after the other, controls first, then treatments in order: what each could have, and who took what."""
    here, free, controls = None, None, []
    for batch in batches:
        out: list[tuple] = []
        for of, kind, seq, score, takes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != here:
                here, free, controls = of, None, []
            if kind == 0:
                controls.append((score, seq))
                continue
            free = free or FreeControls(controls)
            if found := free.nearest(score, caliper):
                out.append((seq, of, found[0], found[1], takes))
                if takes:
                    free.take(found[2])
                    if not free.left:
                        out.append((seq, of, None, None, None))  # from here on the range is closed
        if out:
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["seq", "range", "distance", "control", "took"])


def match(nodes: DataFrame, caliper: float = CALIPER, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(treatment_id, control_id, treatment_outcome, control_outcome) of standardised nodes (seq, id, treated, score, outcome).

    In the order of ``seq`` (unique), each treatment takes the nearest free control within the caliper, the earliest of
    equals. No task sees all nodes: scores are cut into ranges of about ``range_rows`` nodes (4,096 ranges at most; one
    score is never cut), and a round goes over all ranges at once. In it a treatment sees its own range, the one it
    chose, and the nearest one on either side that still had a free control when its turn came; in a range, those that
    chose it take theirs in order, others are told what they could have. Each then chooses the best it was offered.
    What a treatment is offered depends on earlier ones alone, so once nobody changes the choice all have what they
    would have got one by one; the earliest of those in doubt is settled in each round, and mostly all but a few are.
    """
    flat = stage_table(nodes.select(F.col("seq").cast("long"), "treated", F.col("score").cast("double")), "scores")
    parts = min(MOST_RANGES, 1 + flat.count() // range_rows)
    cuts = flat.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 10 * MOST_RANGES)).first()[0] if parts > 1 else []
    edges = np.unique(np.array(cuts or [], np.float64))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_home(edges, b.column(1).to_numpy())), *b.columns], ["range", "seq", "score"])

    homed = "range int, seq long, score double"
    controls = flat.filter("NOT treated").select("seq", "score").mapInArrow(at_home, homed).select("range", F.lit(0).alias("kind"), "seq", "score", F.lit(False).alias("takes"))
    state = flat.filter("treated").select("seq", "score").mapInArrow(at_home, homed).select("seq", "score", F.col("range").alias("choice"))
    closed = np.full(len(edges) + 1, np.iinfo(np.int64).max)
    spare: list[DataFrame] = []
    while True:

        def visit(batches: Iterator[pa.RecordBatch], closed=closed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seq, score, choice = (c.to_numpy() for c in b.columns)
                row, of = _visits(seq, score, choice, edges, closed, caliper)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of, seq[row], score[row], choice[row] == of)], ["range", "seq", "score", "takes"])

        asked = state.mapInArrow(visit, "range int, seq long, score double, takes boolean").select("range", F.lit(1).alias("kind"), "seq", "score", "takes")
        rows = controls.unionByName(asked).repartition("range").sortWithinPartitions("range", "kind", "seq")
        offers = stage_table(rows.mapInArrow(lambda batches: _offers(batches, caliper), "seq long, range int, distance double, control long, took boolean"), "offers")
        best = offers.filter("distance IS NOT NULL").groupBy("seq").agg(F.min(F.struct("distance", "control", "range")).alias("best"), F.max(F.when(F.col("took"), F.col("range"))).alias("held"))
        chosen = stage_table(state.select("seq", "score").join(best, "seq", "left").select("seq", "score", F.coalesce("best.range", F.lit(-1)).alias("choice"), F.col("best.control").alias("control"), F.coalesce("held", F.lit(-1)).alias("held")), "choices")
        before, closed = closed, np.full(len(edges) + 1, np.iinfo(np.int64).max)
        for row in offers.filter("distance IS NULL").select("range", "seq").collect():  # a row a range at most
            closed[row["range"]] = row["seq"]
        doubt = chosen.filter("choice <> held").limit(1).count()
        discard(offers, *spare)
        spare, state = [chosen], chosen.select("seq", "score", "choice")
        # who saw what was decided by the closing moments of the round before: these must hold as well
        if not doubt and (not len(edges) or np.array_equal(before, closed)):
            break
    pairs = chosen.filter("control IS NOT NULL").select(F.col("seq").alias("_t"), F.col("control").alias("_c"))
    side = lambda name: nodes.select(F.col("seq").cast("long").alias(f"_{name[0]}"), F.col("id").alias(f"{name}_id"), F.coalesce(F.col("outcome").cast("double"), F.lit(0.0)).alias(f"{name}_outcome"))
    found = pairs.join(side("treatment"), "_t").join(side("control"), "_c")
    return found.select("treatment_id", "control_id", "treatment_outcome", "control_outcome")


def status(n: Column) -> Column:
    return F.when(n >= VALIDATED, "counterfactual_validated").when(n >= OBSERVATIONAL, "observational").otherwise("hypothesis")


def effect(pairs: DataFrame) -> DataFrame:
    """(ate, n, status, treatment_mean, control_mean, error) of matched pairs."""
    means = pairs.agg(F.count("*").alias("n"), F.avg("treatment_outcome").alias("t"), F.avg("control_outcome").alias("c"))
    return means.select(
        F.coalesce(F.round(F.col("t") - F.col("c"), 3), F.lit(0.0)).alias("ate"), "n", status(F.col("n")).alias("status"), F.round("t", 3).alias("treatment_mean"), F.round("c", 3).alias("control_mean"),
        F.when(F.col("n") == 0, "no match within the caliper").alias("error"),
    )


def result_rows(found: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """The rows of an analysis (as ``analyze`` gives it) for the table of causal results; one with an error leaves none."""
    rows = found.filter("error is null")
    return rows.select(F.uuid().alias("id"), F.lit(treatment).alias("treatment"), F.lit(outcome).alias("outcome"), "ate", F.col("n").alias("n_samples"), "status")


def interpretation(outcome: str, confounder: str) -> Column:
    return F.format_string(f"Treatment effect: %+.3f on {outcome} (%s, %d matched pairs, confounder: {confounder})", "ate", "status", "n")


def analyze(nodes: DataFrame, outcome: str, confounder: str) -> DataFrame:
    """The whole analysis of nodes (seq, id, treated, confounder, outcome): counts, effect, status, text; an error where a side is too small or nothing matches."""
    found = effect(match(standardised(nodes))).crossJoin(F.broadcast(split_counts(nodes).withColumnRenamed("error", "_few")))
    out = found.withColumn("error", F.coalesce("_few", "error")).drop("_few")
    return out.withColumn("confounder_used", F.lit(confounder)).withColumn("interpretation", F.when(F.col("error").isNull(), interpretation(outcome, confounder)))


#: What an analysis has.
ANALYSIS = "ate double, n long, status string, treatment_mean double, control_mean double, error string, treatment_n long, control_n long, confounder_used string, interpretation string"


def analyze_log(events: DataFrame, conditions: dict, outcome: str, candidates: tuple[str, ...] = CONFOUNDERS) -> DataFrame:
    """The analysis of all nodes that a log creates and doesn't tombstone: those whose payload meets the conditions against the others.

    Too few on a side, no confounder in any payload, or no match within the caliper: a row with the error, and the counts.
    """
    made = events.filter("event_type = 'node_created'").join(tombstones(events).select(F.col("node_id").alias("aggregate_id")), "aggregate_id", "left_anti")
    rows = stage_table(ranked(made.select("aggregate_id", "ts", "id", "payload", F.lit(0).alias("_all")), "_all", ["ts", "id"], "seq"), "nodes")
    nodes = rows.select("seq", F.col("aggregate_id").alias("id"), treated(conditions).alias("treated"), "payload")
    counts, named = split_counts(nodes).first(), confounder_of(rows, candidates).first()["confounder"]
    if counts["error"] or named is None:
        status = None if counts["error"] else "hypothesis"
        row = (0.0, 0, status, None, None, counts["error"] or "no confounder in any payload", counts["treatment_n"], counts["control_n"], None, None)
        return events.sparkSession.createDataFrame([row], ANALYSIS)
    number = lambda key: field(f"$.{key}", "double")
    return analyze(nodes.withColumns({"confounder": number(named), "outcome": number(outcome)}), outcome, named)


def imbalance(nodes: DataFrame) -> DataFrame:
    """(smd): the difference of the confounder's means over the root of the mean of both variances."""
    t, c = (F.when(F.col("treated") == side, F.col("confounder")) for side in (True, False))
    return nodes.agg(((F.avg(t) - F.avg(c)) / F.sqrt((F.var_pop(t) + F.var_pop(c)) / 2)).alias("smd"))
