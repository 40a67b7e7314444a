"""Substring dedup: words covered by a 20-word window that also starts earlier are removed.

Every window start is a suffix, cut at ``WINDOW`` words: what repeats at least
that long is a node of that depth in the suffix tree. The tree is never whole.
A suffix is dealt by a prefix of variable length, the one that ends with the
least (by hash) of the ``GRAM``-word grams in its window: 6 to 20 words. Equal
windows have the same least gram at the same place, so no node is split; and
neighbouring suffixes mostly share it and travel as one record, with 48 bits of
each one's label below the prefix. Prefixes are dealt into groups of a bounded
size, counted from the corpus' length.

A task holds the subtrees of one group at a time as their leaves in order:
leaves of equal prefix and label are under one internal node of depth 20. All
but the earliest of them, by document and place, repeat; neighbouring ones join
into the maximal repeats, as (document, first window, windows). Leaves of a
group that outgrows its bound are settled first: of each node only the earliest
is kept and what is beaten goes out, so a passage in very many documents holds
one leaf. The same happens in blocks of a million words before anything is
shuffled: what repeats within a block leaves it as ranges alone.

What travels is some nine bytes a word and, once, the texts with their ranges.

A window lies within one document. Earlier is a smaller doc_id or, in one
document, a smaller start; a null doc_id comes last. Windows of equal place, as
in rows that repeat an id, don't repeat each other; rows of one id and several
texts are judged each by its own text. Null, empty and blank texts, and those
of fewer than 20 words, stay. Texts are taken whole however long; a block holds
one long text at least. An empty table gives an empty result; other columns are
kept by ``deduplicated`` and ignored otherwise, whatever their names.

Words and windows are compared by hashes: 64 bits of the gram and 48 more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_texts, slices, trim
from .neardup import _GAP, _mixed, word_hashes

WINDOW, GRAM = 20, 6
SPAN = WINDOW - GRAM + 1
#: Words of a block, bytes of text whose suffixes make a group, leaves that a task settles at once.
BLOCK, GROUP_BYTES, LEAVES = 1 << 20, 4 << 20, 1 << 21
_LAST = (1 << 63) - 1
_RNG = np.random.default_rng(20240613)
_AT = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LABEL = np.uint64((1 << 48) - 1)


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    size = len(words) - n + 1
    out = np.full(max(size, 0), n, np.uint64)
    for k in range(n if size > 0 else 0):
        out += _AT[k] * words[k : k + size]
    return _mixed(out)


def least_grams(grams: np.ndarray, windows: int) -> np.ndarray:
    """For every window the place of its least gram, the first of equals."""
    least, place = grams[:windows].copy(), np.zeros(windows, np.uint8)
    for k in range(1, SPAN):
        other = grams[k : k + windows]
        smaller = other < least
        least[smaller], place[smaller] = other[smaller], k
    return place


def _ranges(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that begin a run of consecutive starts in one document, the runs' lengths) of sorted places."""
    edge = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]) if len(doc) else np.zeros(0, np.int64)
    return edge, np.diff(np.r_[edge, len(doc)])


def later(node: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which leaves have, under their node, one of an earlier (document, start)."""
    out = np.zeros(len(node), bool)
    order = np.argsort(node)
    new = np.r_[True, node[order][1:] != node[order][:-1]] if len(node) else np.zeros(0, bool)
    several = order[~(new & np.r_[new[1:], True])] if len(node) else order
    if len(several):
        several = several[np.lexsort((start[several], doc[several], node[several]))]
        first = np.r_[True, node[several][1:] != node[several][:-1]]
        head = several[np.flatnonzero(first)][np.cumsum(first) - 1]
        out[several] = (doc[several] != doc[head]) | (start[several] != start[head])
    return out


_LEAF = (("prefix", np.uint64), ("doc", np.int64), ("text", np.int32), ("start", np.uint32), ("place", np.uint8), ("run", np.uint8))
_RANGE = (("doc", np.int64), ("text", np.int32), ("start", np.uint32), ("run", np.uint32))


def packed(leaves: dict[str, np.ndarray], labels: np.ndarray, lost: dict[str, np.ndarray]) -> bytes:
    """Records of neighbouring suffixes, 48 bits a suffix, and ranges that are settled."""
    parts = [np.array([len(leaves["doc"]), len(labels), len(lost["doc"])], np.int64)]
    parts += [leaves[c].astype(t) for c, t in _LEAF] + [labels.astype(np.uint32), (labels >> np.uint64(32)).astype(np.uint16)]
    parts += [lost[c].astype(t) for c, t in _RANGE]
    return b"".join(p.tobytes() for p in parts)


def unpacked(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    records, suffixes, ranges = np.frombuffer(blob, np.int64, 3).tolist()
    at = 24

    def take(kind, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, n, at)
        at += out.nbytes
        return out

    leaves = {c: take(t, records) for c, t in _LEAF}
    labels = take(np.uint32, suffixes).astype(np.uint64)
    labels |= take(np.uint16, suffixes).astype(np.uint64) << np.uint64(32)
    return leaves, labels, {c: take(t, ranges) for c, t in _RANGE}


def block_suffixes(doc: np.ndarray, text: np.ndarray, words: list[np.ndarray], groups: int) -> Iterator[tuple[int, bytes]]:
    """(group, records) of the suffixes of some documents, settled among themselves."""
    order = np.argsort(doc, kind="stable")
    sizes = np.array([len(words[i]) for i in order], np.int64)
    every = np.concatenate([words[i] for i in order])
    windows = len(every) - WINDOW + 1
    if windows < 1:
        return
    row = np.repeat(np.arange(len(order)), sizes)
    start = (np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint32)
    grams, whole = rolled(every, GRAM), rolled(every, WINDOW)
    at = np.flatnonzero(row[:windows] == row[WINDOW - 1 :])
    gram = at + least_grams(grams, windows)[at]
    doc, text = doc[order][row[at]], text[order][row[at]]
    row, start = row[at], start[at]
    beaten = later(whole[at], doc, start)
    edge, run = _ranges(row[beaten], start[beaten])
    lost = {"doc": doc[beaten][edge], "text": text[beaten][edge], "start": start[beaten][edge], "run": run}
    none = {c: np.zeros(0, t) for c, t in _RANGE}
    left = np.flatnonzero(~beaten)
    new = np.r_[True, (at[left][1:] != at[left][:-1] + 1) | (gram[left][1:] != gram[left][:-1])] if len(left) else np.zeros(0, bool)
    edge = np.flatnonzero(new)
    run = np.diff(np.r_[edge, len(left)])
    head = left[edge]
    prefix = grams[gram[head]]
    group = (prefix % np.uint64(groups)).astype(np.int64)
    leaves = {"prefix": prefix, "doc": doc[head], "text": text[head], "start": start[head], "place": gram[head] - at[head], "run": run}
    by = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.r_[True, np.diff(group[by]) != 0]) if len(by) else np.zeros(0, np.int64)
    labels, offset = whole[at[left]] & _LABEL, edge
    for k, (a, b) in enumerate(pairwise([*cut.tolist(), len(by)])):
        some = by[a:b]
        n = run[some]
        suffix = np.repeat(offset[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield int(group[some[0]]), packed({c: v[some] for c, v in leaves.items()}, labels[suffix], none if k else lost)


class Subtrees:
    """The leaves of a group's subtrees, of which the earliest under each node of depth WINDOW stay."""

    COLUMNS = ("prefix", "label", "doc", "text", "start")

    def __init__(self) -> None:
        self.parts: list[dict[str, np.ndarray]] = []
        self.held, self.bound = 0, LEAVES

    def add(self, blob: bytes) -> dict[str, np.ndarray]:
        """Take records in; the ranges that they bring."""
        leaves, labels, lost = unpacked(blob)
        run = leaves["run"].astype(np.int64)
        step = np.arange(len(labels)) - np.repeat(np.cumsum(run) - run, run)
        part = {c: np.repeat(leaves[c], run) for c in ("prefix", "doc", "text", "start")} | {"label": labels}
        part["start"] = part["start"].astype(np.int64) + step
        self.parts.append(part)
        self.held += len(labels)
        return lost

    def settle(self, last: bool) -> dict[str, np.ndarray]:
        """The ranges of leaves that are beaten; the others stay unless this is the ``last`` call."""
        every = {c: np.concatenate([p[c] for p in self.parts]) for c in self.COLUMNS} if self.parts else {c: np.zeros(0, np.int64) for c in self.COLUMNS}
        self.parts, self.held = [], 0
        # nodes are told by the prefix's 64 bits and the label's 48; their mix only brings equal ones together
        mix = _mixed(every["prefix"].astype(np.uint64) ^ (every["label"].astype(np.uint64) * _ODD))
        beaten = later(mix, every["doc"], every["start"])
        if last:
            self.bound = LEAVES
        else:
            self.parts, self.held = [{c: v[~beaten] for c, v in every.items()}], int((~beaten).sum())
            self.bound = max(LEAVES, 2 * self.held)
        out = {c: every[c][beaten] for c in ("doc", "text", "start")}
        by = np.lexsort((out["start"], out["text"], out["doc"]))
        out = {c: v[by] for c, v in out.items()}
        same = np.r_[False, (out["doc"][1:] == out["doc"][:-1]) & (out["text"][1:] == out["text"][:-1])] if len(by) else np.zeros(0, bool)
        edge, run = _ranges(np.cumsum(~same), out["start"])
        return {c: v[edge] for c, v in out.items()} | {"run": run}


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_doc (a null id comes last) and _key, which tells apart the texts of one id, before all columns."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_doc"), F.hash(text_col).alias("_key"), *[F.col(f"`{c}`") for c in docs.columns])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_doc, _key, start, run): windows start .. start + run - 1 of a document also start earlier. A document's runs may touch."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + size // GROUP_BYTES)
    rows = _keyed(docs.select(id_col, text_col), id_col, text_col).select("_doc", "_key", F.col(text_col).alias("text")).filter("text IS NOT NULL")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, text, words = zip(*held, strict=True)
            done = list(block_suffixes(np.array(doc, np.int64), np.array(text, np.int32), list(words), groups))
            held.clear()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.int32()), pa.array([b for _, b in done], pa.binary())], ["part", "leaves"])

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, key, text in zip(*(column(part, c) for c in ("_doc", "_key")), part.column(2), strict=True):
                    found = word_hashes(np.frombuffer(text.as_buffer(), np.uint8), _GAP)
                    if len(found) >= WINDOW:
                        held.append((doc, key, found))
                        total += len(found)
                        if total >= BLOCK:
                            yield from flush()
                            total = 0
        if held:
            yield from flush()
        trim()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, part = Subtrees(), None

        def out(found: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(found["doc"]):
                cols = [pa.array(found[c].astype(t)) for c, t in (("doc", np.int64), ("text", np.int32), ("start", np.int64), ("run", np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["_doc", "_key", "start", "run"])

        for batch in batches:
            for of, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if of != part and part is not None:
                    yield from out(trees.settle(last=True))
                part = of
                yield from out(trees.add(blob.as_buffer()))
                if trees.held > trees.bound:
                    yield from out(trees.settle(last=False))
        yield from out(trees.settle(last=True))
        trim()

    suffixes = rows.mapInArrow(cut, "part int, leaves binary")
    return suffixes.repartition(groups, "part").sortWithinPartitions("part").mapInArrow(grow, "_doc long, _key int, start long, run long")


def kept_words(text: str | None, runs: list[tuple[int, int]] | None) -> tuple[int, list[bytes]]:
    """(words of a text, those that no window of ``runs`` covers)."""
    words = (text or "").encode().split()  # splits at white space of ASCII
    if not runs:
        return len(words), words
    out, at = [], 0
    for start, run in sorted(runs):
        if start > at:
            out += words[at:start]
        at = max(at, start + run + WINDOW - 1)
    return len(words), out + words[at:]


def _with_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row of ``docs``, its columns numbered, with the runs of its text."""
    found = repeats(docs, id_col, text_col).groupBy("_doc", "_key").agg(F.collect_list(F.struct("start", "run")).alias("_runs"))
    return _keyed(docs, id_col, text_col).join(found, ["_doc", "_key"], "left")


def _runs(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int]] | None]:
    for runs in column(batch, "_runs"):
        yield None if runs is None else [(r["start"], r["run"]) for r in runs]


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the kept words, joined by one space."""

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            n, gone, sha = [], [], []
            for text, runs in zip(column(batch, "text"), _runs(batch), strict=True):
                total, kept = kept_words(text, runs)
                n.append(total)
                gone.append(total - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            return {"doc_id": batch.column(0), "n_words": n, "n_removed": gone, "kept_sha256": sha}

        return step

    asked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(_with_runs(asked, "doc_id", "text").select("doc_id", "text", "_runs"), kernel, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with all columns; a text that loses words becomes its kept words, joined by one space, and the length column follows."""
    names, kinds = docs.columns, docs.schema
    at, size = names.index(text_col), names.index(length_col) if length_col in names else None
    numbered = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            cols = {f"c{i}": batch.column(i) for i in range(len(names))}
            old = column(batch, f"c{at}")
            new = [t if not runs else b" ".join(kept_words(t, runs)[1]).decode() for t, runs in zip(old, _runs(batch), strict=True)]
            cols[f"c{at}"] = pa.array(new, cols[f"c{at}"].type)
            if size is not None:
                kept = column(batch, f"c{size}")
                cols[f"c{size}"] = pa.array([k if a is b else len(b) for k, a, b in zip(kept, old, new, strict=True)], cols[f"c{size}"].type)
            return cols

        return step

    rows = _with_runs(numbered, f"c{names.index(id_col)}", f"c{at}")
    out = map_texts(rows.select(*numbered.columns, "_runs"), kernel, numbered.schema, f"c{at}")
    return out.select(*[F.col(f"c{i}").cast(kinds[i].dataType).alias(c) for i, c in enumerate(names)])


REPORT_SQL = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  w AS (SELECT doc_id, ws[i] AS word, i, CASE WHEN i + {WINDOW - 1} <= len(ws) THEN array_to_string(ws[i:i + {WINDOW - 1}], ' ') END AS win FROM d, LATERAL unnest(range(1, len(ws) + 1)) r(i)),
  f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM w),
  k AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
  s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM k GROUP BY 1)
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (doc_id)"""
