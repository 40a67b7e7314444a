"""Near-duplicate detection: MinHash bands, sequential Bayesian pruning, exact checks.

Texts become sets of 5-word shingles (64-bit hashes of the words' bytes, letters
A-Z folded; equal hashes count as equal words). Equal sets form one class first,
so copies never meet as pairs. Class representatives are sketched by ``HASHES``
minima, of which 16 bits are kept; those of ``ROWS`` make a band, and classes that share a band's key are
candidates.

Candidates are checked in two passes. In the first, each bucket's smallest
member is compared with all others: as many pairs as rows. What that links forms
components; buckets whose members all lie in one are done. In the second, the
members of the remaining buckets, whatever their number, are dealt into blocks
of a bounded size; every two blocks meet in a task of their own, where all pairs
across components are compared and only rows of surviving pairs are written.

A comparison looks at ``LOOK`` hashes at a time and stops once the posterior
probability, under a uniform prior, that the similarity reaches the threshold
is below ``MISS``. Survivors are checked on their full shingle sets, which
travel once a task, never once a pair.

With 32 bands of 4 rows a pair of similarity 0.75 shares no band with
probability 5e-6, in buckets of any size.

Whole texts are moved by no step: which rows a table of ids names is told by
filters that are sized to the ids (``IdLevels``).

Texts without words (null, empty, white space) have an empty set and link with
nothing; fewer than 5 words make one shingle. Rows of one id are one document:
its texts' classes are linked, and ``deduplicated`` keeps one row of it, that of
the least hash. Rows without an id stand alone: no component, kept. Ties and
order don't matter, as components are named by their least id; an empty table
gives an empty result, and other columns are neither read nor changed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import TASK_LINKS, connected_components
from .common import column, discard, map_texts, stage_table

WORDS = 5
PERCENT = 75
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
LOOK = 16
MISS = 1e-6
#: What a block of an open bucket, or a task that checks full sets, may hold: members, and shingles of theirs (8 bytes each).
BLOCK, SHINGLES = 4096, 1 << 20
#: Bits an id gets in a filter, ids above which one is used at all, and the largest filter (32 MB); beyond it more rows pass, and joins decide.
ID_BITS, FEW_IDS, MOST_BITS = 8, 100_000, 1 << 28

#: Rows of a staged table that go into a file: narrow ones, and ones that are costly to make.
NARROW, COSTLY = 250_000, 20_000

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = (_RNG.integers(1, 1 << 31, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
_PLUS = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_BASE, _GAP = 0x9E3779B97F4A7C15, np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def word_hashes(raw: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word of a text's bytes, in order; ``gap`` tells which bytes part words."""
    edge = np.flatnonzero(np.diff(np.r_[True, gap[raw], True].astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw))
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[raw] * up[: len(raw)])]
    return _mixed((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    word = word_hashes(np.frombuffer((text or "").encode().lower(), np.uint8), _GAP)
    m = len(word)
    if not m:
        return np.zeros(0, np.uint64)
    n = min(m, WORDS)
    h = np.full(m - n + 1, n, np.uint64)
    for k in range(n):
        h = h + _PLACE[k] * word[k : m - n + 1 + k]
    return np.unique(_mixed(h))


def minima(found: np.ndarray) -> np.ndarray:
    """HASHES minima of a set that isn't empty."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        h = np.multiply.outer(_MULT, x[i : i + 1024])
        h += _PLUS[:, None]
        np.minimum(out, h.min(1), out)
    return out


def sketch_of(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16 bits of each minimum, the bands' keys: the bits of their rows, so that equal bits are an equal key and no pair is looked for in a band that its buckets don't share)."""
    low = minima(found).astype(np.uint64)
    sig = _mixed(low * np.uint64(0x9E3779B97F4A7C15) + np.arange(HASHES, dtype=np.uint64)).astype(np.uint16)
    return sig, sig.view(np.int64)


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """Of the first LOOK, 2 LOOK, ... hashes, how many must agree for a pair to go on.

    With m of n agreeing the posterior is Beta(m + 1, n - m + 1); its mass above t is P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(LOOK, HASHES + 1, LOOK):
        below, m = 0.0, 0
        while m <= n:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, need: list[int]) -> np.ndarray:
    """Which rows of two signature matrices survive the sequential comparison."""
    live = np.arange(len(a))
    agree = np.zeros(len(a), np.int32)
    for k, least in enumerate(need):
        at = slice(k * LOOK, (k + 1) * LOOK)
        agree[live] += (a[live, at] == b[live, at]).sum(1, dtype=np.int32)
        live = live[agree[live] >= least]
    return live


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class (128 bits of the set; null if empty), sig, bands."""

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_shingles", "class", "sig", "bands")}
            for t in column(batch, text_col):
                found = shingles(t)
                row: tuple = (0, None, None, None)
                if len(found):
                    sig, keys = sketch_of(found)
                    weight = _mixed(found + np.uint64(1))
                    name = np.array([found.sum(dtype=np.uint64), (weight * found).sum(dtype=np.uint64)]).tobytes()
                    row = (len(found), name, sig.tobytes(), keys.tolist())
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return {"doc_id": column(batch, id_col)} | out

        return step

    return map_texts(docs.select(id_col, text_col), kernel, "doc_id long, n_shingles long, class binary, sig binary, bands array<long>", text_col)


def _pruned(pairs: DataFrame, sigs: DataFrame, need: list[int]) -> DataFrame:
    """Pairs (a, b, n of a) whose signatures survive; a hot ``b`` is split by the skew handling of the join."""
    rows = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")

    def kernel():
        def step(batch: pa.RecordBatch) -> dict | None:
            x, y = (np.frombuffer(b"".join(column(batch, c)), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            keep = surviving(x, y, need)
            return {c: np.array(column(batch, c), np.int64)[keep] for c in ("a", "b", "n")} if len(keep) else None

        return step

    return map_texts(rows.select("a", "b", "n", "sig_a", "sig_b"), kernel, "a long, b long, n long", "sig_a")


def _spots(ids: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each id among ``size`` (a power of two), others at each level."""
    h = _mixed(ids.view(np.uint64) + np.uint64((level + 1) * _BASE & (1 << 64) - 1))
    return h & np.uint64(size - 1), (h >> np.uint64(32)) & np.uint64(size - 1)


def _bits(ids: DataFrame, n: int, level: int) -> np.ndarray:
    """A filter of ``n`` ids (id): words of 64 bits, made in parts and joined by word."""
    size = min(MOST_BITS, max(1 << 10, 1 << (ID_BITS * n - 1).bit_length()))

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            at = np.unique(np.concatenate(_spots(np.array(column(batch, "id"), np.int64), level, size)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            return {"word": word.view(np.int64), "bits": bits.view(np.int64)}

        return step

    words = map_texts(ids.select("id"), kernel, "word long, bits long", None).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


@dataclass
class IdLevels:
    """Which ids of a table are named, told from filters in turn: what passes one is sure only if the next doesn't hold it.

    Level 0 has the named ids, level 1 the other ids of the table that level 0 lets through, level 2 the named ones that
    level 1 lets through, and so on; ``last`` are the few ids of the level after, as they are. So every id of the table is
    told exactly. Where ``sure`` is False there is one level alone, and an id that passes it may be either.
    """

    levels: list[np.ndarray] = field(default_factory=list)
    last: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sure: bool = True

    def passes(self, ids: np.ndarray, level: int) -> np.ndarray:
        bits = self.levels[level]
        a, b = _spots(ids, level, 64 * len(bits))
        has = lambda at: (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return (has(a) & has(b)).astype(bool)

    def named(self, ids: np.ndarray) -> np.ndarray:
        """Which ids are named."""
        out = np.zeros(len(ids), bool)
        live = np.arange(len(ids))
        for k in range(len(self.levels)):
            live = live[self.passes(ids[live], k)]
            out[live] = k % 2 == 0
        if self.sure:
            live = live[np.isin(ids[live], self.last)]
            out[live] = len(self.levels) % 2 == 0
        return out

    def keep(self, ids: DataFrame, level: int) -> DataFrame:
        """The rows of ``ids`` (id) that a level lets through."""
        shared = ids.sparkSession.sparkContext.broadcast(self)

        def kernel():
            of = shared.value

            def step(batch: pa.RecordBatch) -> dict:
                got = np.array(column(batch, "id"), np.int64)
                return {"id": got[of.passes(got, level)]}

            return step

        return map_texts(ids.select("id"), kernel, "id long", None)


def first_level(ids: DataFrame) -> IdLevels:
    """One filter that lets through the ids of ``ids`` (id), and few others while it isn't full."""
    n = ids.count()
    if n <= FEW_IDS:
        return IdLevels([], np.unique(ids.toArrow()["id"].to_numpy()))
    return IdLevels([_bits(ids, n, 0)], sure=False)


def id_levels(named: DataFrame, others: DataFrame) -> IdLevels:
    """Levels that tell ``named`` (id) from ``others`` (id) exactly; only the first, and not sure, where one would be over MOST_BITS."""
    out, sets, spare = IdLevels(), [named, others], []
    while (n := sets[0].count()) > FEW_IDS:
        full = ID_BITS * n > MOST_BITS
        if not (full and out.levels):
            out.levels.append(_bits(sets[0], n, len(out.levels)))
        if full:
            discard(*spare)
            return IdLevels(out.levels[:1], sure=False)
        sets = [stage_table(out.keep(sets[1], len(out.levels) - 1), "ids"), sets[0]]
        spare.append(sets[0])
    out.last = np.unique(sets[0].toArrow()["id"].to_numpy())
    discard(*spare)
    return out


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if not len(x) or not len(y):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, found): the full sets of the texts that ``ids`` (id) names, and of few others."""
    wanted = docs.sparkSession.sparkContext.broadcast(first_level(ids))
    asked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull())

    def cut():
        levels = wanted.value

        def step(batch: pa.RecordBatch) -> dict | None:
            part = batch.filter(pa.array(levels.named(np.array(column(batch, "id"), np.int64))))
            found = [shingles(t).tobytes() for t in column(part, "text")]
            return {"id": column(part, "id"), "found": found} if found else None

        return step

    return map_texts(asked, cut, "id long, found binary")


def _files(rows: int, each: int = NARROW) -> int:
    return 1 + rows // each


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Pairs (a, b; n of a) whose full sets reach the threshold.

    The partners of one ``b`` are dealt into tasks of bounded size, and its set travels once a task. Partners have at
    least three quarters of its shingles, so that this at most doubles what moves.
    """
    files = _files(pairs.count(), COSTLY)
    load = pairs.groupBy("b").agg(F.greatest(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / BLOCK)).cast("int").alias("tasks"))
    dealt = pairs.join(load, "b").select("a", "b", F.pmod(F.xxhash64("a"), "tasks").cast("int").alias("task"))
    asked = stage_table(dealt.unionByName(dealt.select(F.col("b").alias("a"), "b", "task").distinct()), "asked", files)
    sets = _sets(asked.select(F.col("a").alias("id")).distinct(), docs, id_col, text_col)
    rows = asked.join(sets.withColumnRenamed("id", "a"), "a")

    def compare(table: pa.Table) -> pa.Table:
        ids = table["a"].to_pylist()
        found = [np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()]
        b = table["b"][0].as_py()
        heads = [x for i, x in zip(ids, found, strict=True) if i == b]
        got = sorted({i for i, x in zip(ids, found, strict=True) if i != b and any(alike(x, y, percent) for y in heads)})
        return pa.table({"a": pa.array(got, pa.int64()), "b": pa.array([b] * len(got), pa.int64())})

    out = stage_table(rows.groupBy("b", "task").applyInArrow(compare, "a long, b long"), "verified", files)
    discard(asked)
    return out


def _open_buckets(shared: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, band, rep, n, comp) of all buckets, and those buckets whose members lie in more than one component."""
    rows = shared.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left").select("bucket", "band", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    rows = stage_table(rows, "bucketed", _files(shared.count()))
    # the component of the smallest member is the bucket's core
    return rows, rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("members"), F.min(F.struct("rep", "comp")).alias("least")).filter("lo <> hi and members > 2").select("bucket", F.col("least.comp").alias("core"))


def _meeting(table: pa.Table, need: list[int], percent: int) -> tuple[dict[str, np.ndarray], list[tuple[int, np.ndarray]]]:
    """(columns by rising rep, surviving pairs as (row, later rows)) of one task of an open bucket.

    A pair that shares several bands is looked at in its first one only.
    """
    order = np.argsort(np.array(table["rep"].to_pylist()), kind="stable")
    cols = {c: np.array(table[c].to_pylist(), np.int64)[order] for c in ("rep", "n", "comp", "mine", "out", "band")}
    cols["order"] = order
    rep, n, comp, mine, out = (cols[c] for c in ("rep", "n", "comp", "mine", "out"))
    sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)[order]
    kind, i, j, whole = (table[c][0].as_py() for c in ("kind", "i", "j", "whole"))
    pairs = []
    for k in range(len(rep) - 1):
        later = np.arange(k + 1, len(rep))
        meet = (comp[later] != comp[k]) & (100 * np.minimum(n[later], n[k]) >= percent * np.maximum(n[later], n[k]))
        if kind == 0:  # insiders with outsiders; the only block of outsiders also within itself, once
            meet &= (out[later] != out[k]) | (whole and i == 0)
        elif i != j:
            meet &= mine[later] != mine[k]
        later = later[meet]
        if len(later):
            later = later[surviving(np.broadcast_to(sig[k], (len(later), HASHES)), sig[later], need)]
        if len(later):
            same = (sig[later] == sig[k]).reshape(-1, BANDS, ROWS).all(2)
            later = later[same.argmax(1) == cols["band"][k]]
        if len(later):
            pairs.append((k, later))
    return cols, pairs


def _across(rows: DataFrame, open_: DataFrame, reps: DataFrame, docs: DataFrame, need: list[int], percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) across components within open buckets, verified on full sets; pairs never leave their task."""
    # Insiders share the component of the bucket's smallest member and need not meet each other; outsiders meet all.
    held = rows.join(open_, "bucket").withColumn("out", F.col("comp") != F.col("core")).drop("core")
    blocks = lambda who: F.greatest(F.ceil(F.count_if(who) / BLOCK), F.ceil(F.sum(F.when(who, F.col("n")).otherwise(0)) / SHINGLES)).cast("int")
    size = held.groupBy("bucket").agg(blocks(~F.col("out")).alias("n_in"), blocks(F.col("out")).alias("n_out"))
    held = held.join(size, "bucket")
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("out"), F.col("n_out")).otherwise(F.col("n_in"))).cast("int")
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    among = F.when(F.col("n_out") > 1, F.transform(every("n_out"), lambda o: task(1, F.least("mine", o), F.greatest("mine", o)))).otherwise(F.filter(F.array(task(1, F.col("mine"), F.col("mine"))), lambda _: F.lit(False)))
    tasks = F.when(F.col("out"), F.concat(F.transform(every("n_in"), lambda i: task(0, i, F.col("mine"))), among)).otherwise(F.transform(every("n_out"), lambda o: task(0, F.col("mine"), o)))
    held = held.withColumn("mine", mine).withColumn("whole", F.col("n_out") == 1).withColumn("t", F.explode(tasks))
    held = stage_table(held.select("bucket", "t.*", "mine", "out", "whole", "band", "rep", "n", "comp").join(reps.select("rep", "sig"), "rep"), "met")
    key = ["bucket", "kind", "i", "j"]

    def ends(table: pa.Table) -> pa.Table:
        """The rows of a task that have a surviving pair."""
        cols, pairs = _meeting(table, need, percent)
        some = np.unique(np.concatenate([np.r_[k, later] for k, later in pairs])) if pairs else np.zeros(0, np.int64)
        return table.take(pa.array(cols["order"][some]))

    near = stage_table(held.groupBy(*key).applyInArrow(ends, held.schema), "near")
    discard(held)
    met = near
    sets = _sets(near.select(F.col("rep").alias("id")).distinct(), docs, id_col, text_col)
    near = near.join(sets.select(F.col("id").alias("rep"), "found").dropDuplicates(["rep"]), "rep")

    def check(table: pa.Table) -> pa.Table:
        """Links that join components, each pair checked on its sets unless it is joined already."""
        cols, pairs = _meeting(table, need, percent)
        found = [np.frombuffer(x, np.uint64) for x in table["found"].to_pylist()]
        comp, order = cols["comp"].tolist(), cols["order"]
        root = {c: c for c in comp}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a_out, b_out = [], []
        for k, later in pairs:
            for m in later.tolist():
                x, y = top(comp[k]), top(comp[m])
                if x != y and alike(found[order[k]], found[order[m]], percent):
                    root[x] = y
                    a_out.append(int(cols["rep"][m]))
                    b_out.append(int(cols["rep"][k]))
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    out = stage_table(near.groupBy(*key).applyInArrow(check, "a long, b long").distinct(), "links", _files(met.count(), COSTLY))
    discard(met)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of ``docs``, a staged table."""
    need = least_matches(percent, miss)
    sketched = stage_table(sketches(docs, id_col, text_col), "sketches")
    some = sketched.filter("doc_id is not null and class is not null")
    classes = some.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("n_shingles", "sig", "bands"), "doc_id").alias("x"))
    classes = stage_table(classes.select("class", "rep", F.col("x.n_shingles").alias("n"), "x.sig", "x.bands"), "classes")
    reps = classes.groupBy("rep").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")) if _repeated(classes) else classes.select("rep", "n", "sig", "bands")
    banded = classes.select(F.posexplode("bands").alias("band", "key"), "rep", "n").select(F.xxhash64("band", "key").alias("bucket"), F.col("band").cast("byte").alias("band"), "rep", "n")
    heads = banded.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("head"), F.max("rep").alias("last")).filter("head.rep <> last")
    shared = stage_table(banded.join(heads.select("bucket", "head"), "bucket"), "buckets", _files(BANDS * classes.count(), 2 * NARROW))
    fits = F.col("n") * 100 >= percent * F.col("head.n")
    fits &= F.col("head.n") * 100 >= percent * F.col("n")
    pairs = shared.filter((F.col("rep") != F.col("head.rep")) & fits).groupBy(F.col("rep").alias("a"), F.col("head.rep").alias("b")).agg(F.max("n").alias("n"))
    n = shared.count()
    first = stage_table(_pruned(pairs, reps, need), "pairs", _files(n, 2 * COSTLY))
    links = _verified(first, docs, id_col, text_col, percent)
    # one id with several texts links their classes
    known = stage_table(connected_components(links).coalesce(1 + links.count() // TASK_LINKS), "components")
    rows, open_ = _open_buckets(shared, known)
    open_ = stage_table(open_, "open", _files(n))
    more = _across(rows, open_, reps, docs, need, percent, id_col, text_col)
    spare = [shared, first, rows, open_, links, more]
    if more.take(1):
        spare.append(known)
        known = stage_table(connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    named = sketched.select("doc_id", "n_shingles", "class").join(classes.select("class", "rep"), "class", "left")
    named = named.join(known.select(F.col("node").alias("rep"), "component"), "rep", "left")
    out = named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))
    out = stage_table(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "groups", _files(sketched.count()))
    discard(*spare, sketched, classes, known)
    return out


def _repeated(classes: DataFrame) -> bool:
    """Whether one id stands for several sets, as rows that share an id but not their text."""
    return bool(classes.groupBy("rep").count().filter("count > 1").take(1))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with all their columns, one document of each group and one row of each id; rows without an id stay.

    ``docs`` is filtered where it is read. Only where an id has several rows are these few gathered, by id.
    """
    found = near_duplicates(docs, id_col=id_col, **how)
    per = stage_table(found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "ids", _files(found.count()))
    gone = per.filter("not kept").select("id")
    levels = id_levels(gone, per.filter("kept").select("id"))
    left = _without(docs, levels, id_col)
    if not levels.sure:  # more ids than a filter takes: rows that pass it are told apart by a join
        left = left.unionByName(_without(docs, levels, id_col, named=True).join(gone, F.col(id_col) == gone["id"], "left_anti"))
    if (again := per.filter("kept and n > 1").select("id")).take(1):
        many = id_levels(again, per.filter("n = 1").select("id"))
        cols = [F.col(f"`{c}`") for c in docs.columns]
        rows = _without(left, many, id_col, named=True)
        if not many.sure:
            rows = rows.join(again, F.col(id_col) == again["id"], "left_semi")
            rest = left.join(again, F.col(id_col) == again["id"], "left_anti")
        else:
            rest = _without(left, many, id_col)
        one = rows.groupBy(F.col(id_col).alias("_of")).agg(F.min_by(F.struct(*cols), F.xxhash64(*cols)).alias("_row"))
        left = rest.unionByName(one.select("_row.*"))
    return left


def _without(docs: DataFrame, levels: IdLevels, id_col: str, named: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id isn't among those named, or only those whose id is; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def kernel():
        of = shared.value

        def step(batch: pa.RecordBatch) -> dict | None:
            ids = batch.column(batch.schema.get_field_index(id_col))
            some = of.named(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) & ~ids.is_null().to_numpy(zero_copy_only=False)
            kept = batch.filter(pa.array(some if named else ~some))
            return {n: kept.column(i) for i, n in enumerate(kept.schema.names)} if kept.num_rows else None

        return step

    return map_texts(docs, kernel, docs.schema, None)
