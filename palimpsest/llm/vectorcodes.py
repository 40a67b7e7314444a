"""Vector codes: parts of vectors assigned to learned codebooks, with the search of a vector-approximation file.

A vector's components become integers, floor(4096 x), and it is cut into equal
consecutive parts. Each part position has a codebook of a few entries, which
starts as that part of the first vectors by id and moves to the floor of the
mean of what is assigned to it, round by round. All is integer arithmetic, so
that neither order nor partitioning changes a result.

The nearest entry is found as in a VA file: the entries' coordinates are cut
into ``2 ** BITS`` cells a dimension. For every query part a lookup table holds,
for each dimension and cell, the least and the largest squared distance to that
cell; sums over the dimensions bound an entry's distance from both sides.
Entries whose lower bound exceeds the least upper bound are out, and only the
others get their exact distance.

A round is one pass without a shuffle but for a sum a part and entry from each
task; codebooks (parts x entries x width numbers) are all that the driver sees.

Dropped are rows whose vector is null, holds a null or a component that isn't
finite, or has not the length of the first kept one (or one that isn't a
multiple of the parts). Fewer vectors than entries make smaller codebooks; rows
of equal ids are ordered by their components, null ids come last. Equal rows are
all coded. An empty table, or one with nothing kept, gives an empty result.
Components must stay below 2^16 in magnitude, else the query fails and says so.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import column, map_texts, stage_table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits that approximate a coordinate of an entry.
BITS = 3
#: Query parts compared at once.
CHUNK = 2048
LIMIT = 1 << 16


def quantised(batch: pa.RecordBatch, name: str, length: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are kept, their integer components)."""
    lists = batch.column(batch.schema.get_field_index(name))
    there = ~np.asarray(lists.is_null())
    flat = lists.flatten()  # of rows that aren't null
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.zeros(len(lists), np.int64)
    sizes[there] = lists.value_lengths().filter(pa.array(there)).to_numpy(zero_copy_only=False)
    stop = np.cumsum(sizes)
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]  # a null component is NaN here
    kept = there & (sizes > 0) & (sizes % PARTS == 0) & (bad[stop] == bad[stop - sizes])
    if length is not None:
        kept &= sizes == length
    if not kept.any():
        return kept, np.zeros((0, length or 0), np.int64)
    length = length or int(sizes[kept][0])
    rows = values[(stop - sizes)[kept][:, None] + np.arange(length)] if (sizes[kept] == length).all() else None
    if rows is None:
        raise ValueError("vectors of several lengths need a length")
    if np.abs(rows).max() >= LIMIT:
        raise ValueError(f"components must stay below {LIMIT} in magnitude")
    return kept, np.floor(SCALE * rows).astype(np.int64)


@dataclass
class Book:
    """The codebooks (parts x entries x width) and the cells of their coordinates."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        low, high = self.entries.min(1), self.entries.max(1)  # a dimension's range over its entries
        cells = 1 << BITS
        width = (high - low) // cells + 1
        self.cell = (self.entries - low[:, None]) // width[:, None]
        edge = low[..., None] + width[..., None] * np.arange(cells + 1)
        self.least, self.most = edge[..., :-1], edge[..., 1:] - 1  # the integers of a cell

    def bounds(self, parts: np.ndarray, position: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) squared distances of query parts (rows x width) to each entry, by lookup."""
        x = parts[:, :, None]
        least, most, cell = self.least[position], self.most[position], self.cell[position]
        near = np.maximum(np.maximum(least - x, x - most), 0) ** 2
        far = np.maximum(np.abs(x - least), np.abs(x - most)) ** 2
        lower = upper = 0
        for d in range(parts.shape[1]):
            lower = lower + near[:, d, cell[:, d]]
            upper = upper + far[:, d, cell[:, d]]
        return lower, upper

    def nearest(self, parts: np.ndarray, position: int) -> tuple[np.ndarray, np.ndarray]:
        """(entry, its squared distance) of every query part; the lower of equally near entries."""
        lower, upper = self.bounds(parts, position)
        row, entry = np.nonzero(lower <= upper.min(1, keepdims=True))
        exact = ((parts[row] - self.entries[position][entry]) ** 2).sum(1)
        best = np.minimum.reduceat(exact, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
        hit = np.flatnonzero(exact == best[row])
        first = hit[np.unique(row[hit], return_index=True)[1]]
        return entry[first], best

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x parts codes, rows x parts distances)."""
        parts, _, width = self.entries.shape
        code, far = (np.zeros((len(vectors), parts), np.int64) for _ in range(2))
        for i in range(0, len(vectors), CHUNK):
            cut = vectors[i : i + CHUNK].reshape(-1, parts, width)
            for p in range(parts):
                code[i : i + CHUNK, p], far[i : i + CHUNK, p] = self.nearest(cut[:, p], p)
        return code, far

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def first_book(vectors: DataFrame, entries: int = ENTRIES, id_col: str = "vec_id", vector_col: str = "embedding") -> Book | None:
    """Codebooks of the first kept vectors by id; None where there are none."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    # judged before any row reaches Python
    usable = rows.filter(f"size(v) > 0 AND size(v) % {PARTS} = 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    order = [F.asc_nulls_last("id"), F.transform("v", lambda x: F.floor(SCALE * x.cast("double")))]
    head = usable.orderBy(*order).limit(1).collect()
    if not head:
        return None
    rows = usable.filter(F.size("v") == len(head[0]["v"])).orderBy(*order).limit(entries).collect()
    found = np.floor(SCALE * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    return Book(found.reshape(len(found), PARTS, -1).transpose(1, 0, 2))


def moved(vectors: DataFrame, book: Book, id_col: str = "vec_id", vector_col: str = "embedding") -> Book:
    """The codebooks after a round: each entry at the floor of the mean of its parts; unused ones stay."""
    parts, entries, width = book.entries.shape

    def kernel():
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)

        def step(batch: pa.RecordBatch) -> dict:
            _, rows = quantised(batch, "v", parts * width)
            total[:], count[:] = 0, 0
            if len(rows):
                code, _ = book.codes(rows)
                cut = rows.reshape(-1, parts, width)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], cut[:, p])
                    count[p] = np.bincount(code[:, p], minlength=entries)
            used = np.flatnonzero(count.ravel())
            return {"place": used.astype(np.int32), "n": count.ravel()[used], "total": pa.array(list(total.reshape(-1, width)[used]), pa.list_(pa.int64()))}

        return step

    sums = map_texts(vectors.select(F.col(f"`{vector_col}`").alias("v")), kernel, "place int, n long, total array<long>", None)
    out = book.entries.copy().reshape(-1, width)
    for row in sums.groupBy("place").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"s{d}") for d in range(width)]).collect():
        out[row["place"]] = [row[f"s{d}"] // row["n"] for d in range(width)]
    return Book(out.reshape(parts, entries, width))


def learn(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> Book | None:
    book = first_book(vectors, entries, id_col, vector_col)
    for _ in range(rounds if book else 0):
        book = moved(vectors, book, id_col, vector_col)
    return book


def encode(vectors: DataFrame, book: Book, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part), error: a row for every kept vector."""
    parts, _, width = book.entries.shape
    kind = dict(vectors.dtypes)[label_col]

    def kernel():
        def step(batch: pa.RecordBatch) -> dict | None:
            kept, rows = quantised(batch, "v", parts * width)
            if not len(rows):
                return None
            code, far = book.codes(rows)
            held = batch.filter(pa.array(kept))
            return {"vec_id": held.column(0), "label": held.column(1), "code": [bytes(c).hex() for c in code.astype(np.uint8)], "error": far.sum(1)}

        return step

    rows = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    return map_texts(rows, kernel, f"vec_id long, label {kind}, code string, error long", None)


def decode(codes: DataFrame, book: Book, code_col: str = "code") -> DataFrame:
    """``codes`` with approx: the vector that a code stands for, in the original scale."""

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            digits = [bytes.fromhex(c) if c is not None else None for c in column(batch, code_col)]
            approx = [None if c is None else np.concatenate([book.entries[p][e] for p, e in enumerate(c)]) / SCALE for c in digits]
            return {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"approx": approx}

        return step

    schema = codes.drop("approx").schema.add("approx", ArrayType(DoubleType()))
    return map_texts(codes.drop("approx"), kernel, schema, None)


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (the errors of all rows of a label), codebooks_sha256."""
    book = learn(vectors, entries, rounds, id_col, vector_col)
    if book is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = stage_table(encode(vectors, book, id_col, vector_col, label_col), "codes")
    # labels may be many or few; the join is dealt by label, and a hot one is split as the plan sees it
    per = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = coded.join(per, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(book.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by nested queries: rounds written out, distances over all entries."""
    dims = 8
    comps = ", ".join(f"floor(4096 * embedding[part * {dims} + {d + 1}]::DOUBLE)::BIGINT AS x{d}" for d in range(dims))
    far = " + ".join(f"(p.x{d} - b.x{d}) * (p.x{d} - b.x{d})" for d in range(dims))
    names = ", ".join(f"x{d}" for d in range(dims))
    out = [
        "kept AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, part, {comps} FROM kept CROSS JOIN range({PARTS}) r(part))",
        f"book0 AS MATERIALIZED (SELECT part, dense_rank() OVER (ORDER BY vec_id) - 1 AS entry, {names} FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES}))",
    ]
    for k in range(ROUNDS + 1):
        out.append(f"far{k} AS MATERIALIZED (SELECT p.vec_id, p.part, min({far}) AS d, arg_min(b.entry, ({far}, b.entry)) AS entry FROM parts p JOIN book{k} b ON b.part = p.part GROUP BY 1, 2)")
        if k < ROUNDS:
            means = ", ".join(f"floor(sum(p.x{d})::DOUBLE / count(*))::BIGINT AS x{d}" for d in range(dims))
            out.append(f"mean{k} AS (SELECT part, entry, {means} FROM parts p JOIN far{k} USING (vec_id, part) GROUP BY 1, 2)")
            out.append(f"book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, {', '.join(f'coalesce(m.x{d}, b.x{d}) AS x{d}' for d in range(dims))} FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))")
    last = " || ',' || ".join(f"x{d}" for d in range(dims))
    out.append(f"coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM far{ROUNDS} GROUP BY 1)")
    return f"""WITH {', '.join(out)}
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg({last}, ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded JOIN kept USING (vec_id)"""


CODES_SQL = _sql()
