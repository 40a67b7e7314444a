"""Exact top-k search: block-max WAND over an inverted index for BM25, per shard, merged under global statistics.

The index is a table of blocks of up to ``BLOCK_DOCS`` documents: sorted term
hashes, postings and lengths. Blocks gather documents with the same most
frequent term, so that they differ in what they can score. A shard is the blocks
of a task, ``SHARD_BLOCKS`` of them, which are numbered in turn; a term's list
in a shard has an entry for each block that has the term, with the block's
largest impact, and the list's largest.

Each query walks a shard with one cursor a term. Its pivot is the first block at
which the lists' maxima, added up in the order of their cursors, reach the
query's k-th score so far; cursors before it move up to it, past blocks that
cannot hold a result. There the maxima of the block itself are added up, and
only if these reach the k-th score its documents are scored: by the heavy terms,
without which no document can do, and where one still may, by the light ones
too. Then the cursors at the pivot go on. Many queries move at once, each with cursors and pivots of its
own. A task walks a few shards in turn and carries the k best over; the first walk
begins with the most promising block.

Shards' lists are merged to the exact k best: document counts, mean length and
document frequencies are those of the whole table, and a document's score is
rounded to ``DIGITS`` places, so that it is the same in any shard. Ties go to the
smaller id.

Queries go in passes of at most ``PASS_TERMS`` terms, which bounds what the
driver holds and broadcasts; a pass reads the table of frequencies, which are
counted once for all passes, and the index once to search. Null and empty texts are documents of length 0 that nothing
finds, and queries that find nothing. Rows without an id can't be named: they
are not indexed, not counted, and no queries. Repeated rows are documents of
their own, a repeated query id has one list of the best of its texts. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, map_texts, slices, stage_table
from .neardup import word_hashes

BLOCK_DOCS = 256
#: Documents (and terms of theirs) that are sorted into blocks at once.
SORT_DOCS, SORT_TERMS = 16 * BLOCK_DOCS, 2_000_000
#: Blocks that are walked at once, and those of a task.
SHARD_BLOCKS, TASK_BLOCKS = 32, 64
PASS_TERMS, PASS_QUERIES = 2_000_000, 50_000
#: (query, term) cursors that move at once.
CHUNK_PAIRS = 20_000
DIGITS = 6
#: A term is dense in a block if one of so many documents has it.
DENSE = 16
K1, B = 1.2, 0.75

#: What parts words: all ASCII but letters and digits.
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False

#: Counts of a term's postings are one less than they are, in a byte; tfs have the width that the largest of a block needs.
INDEX = "docs binary, lens binary, terms binary, counts binary, posts binary, tfs binary"


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct terms as sorted hashes, how often each occurs)."""
    return np.unique(word_hashes(np.frombuffer((text or "").encode().lower(), np.uint8), _GAP), return_counts=True)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a block; no shuffle."""

    names = [f.split()[0] for f in INDEX.split(", ")]

    def block(rows: list) -> tuple:
        term = np.concatenate([r[2] for r in rows])
        tf = np.concatenate([r[3] for r in rows]).astype(np.uint32)
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows]).astype(np.uint8)
        order = np.argsort(term, kind="stable")
        kinds, count = np.unique(term, return_counts=True)
        tf = tf[order].astype(np.min_scalar_type(tf.max(initial=0)))
        ids = np.array([r[0] for r in rows], np.int64)
        lens = np.array([r[3].sum() for r in rows], np.int64)
        return tuple(x.tobytes() for x in (ids, lens, kinds, (count - 1).astype(np.uint8), doc[order], tf))

    def sort(rows: list) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[1], r[0]))
        for k in range(0, len(rows), BLOCK_DOCS):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block(rows[k : k + BLOCK_DOCS])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, load = [], 0
        for batch in batches:
            for part in slices(batch, text_col):
                for i, t in zip(column(part, id_col), column(part, text_col), strict=True):
                    if i is not None:
                        terms, tf = terms_of(t)
                        rows.append((i, int(terms[tf.argmax()]) if len(terms) else 0, terms, tf.astype(np.uint32)))
                        load += len(terms)
                        if len(rows) == SORT_DOCS or load > SORT_TERMS:
                            yield from sort(rows)
                            rows, load = [], 0
        yield from sort(rows)

    return docs.select(id_col, text_col).mapInArrow(run, INDEX)


class _Block:
    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.docs, self.lens = get("docs", np.int64), get("lens", np.int64)
        self.terms, self.counts = get("terms", np.uint64), get("counts", np.uint8).astype(np.int32) + 1
        self.posts = get("posts", np.uint8)
        self.tfs = get("tfs", f"u{len(row['tfs']) // max(1, len(self.posts))}" if len(self.posts) else np.uint8)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for part in slices(batch, "tfs"):
            for row in part.to_pylist():
                yield _Block(row)


class _Queries:
    """A pass: queries' ids, their terms as places among the sorted distinct ones, and how often each occurs in its query."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        terms = [np.frombuffer(r[1], np.uint64) for r in rows]
        self.size = np.array([len(t) for t in terms], np.int64)
        self.kinds, at = np.unique(np.concatenate(terms), return_inverse=True)
        self.at = at.astype(np.int32)
        self.tf = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows]).astype(np.float64)
        self.first = np.cumsum(self.size) - self.size


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n): documents that have each term, of all terms there are; a task counts its own before they are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, total = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            term, n = (np.concatenate(x) for x in zip((kinds, total), *held, strict=True))
            order = np.argsort(term, kind="stable")
            term = term[order]
            first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]][: len(term)])
            return term[first], np.add.reduceat(n[order], first) if len(first) else n

        for b in _blocks(batches):
            held.append((b.terms, b.counts.astype(np.int64)))
            if len(held) == SHARD_BLOCKS:
                (kinds, total), held = merged(), []
        kinds, total = merged()
        for i in range(0, len(kinds), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(kinds[i : i + 50_000].view(np.int64)), pa.array(total[i : i + 50_000])], ["term", "n"])

    return index.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _known(found: DataFrame, kinds: np.ndarray) -> np.ndarray:
    """Of a pass' sorted terms, documents of the whole table that have each."""
    shared = found.sparkSession.sparkContext.broadcast(kinds)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for b in batches:
            term = b.column(0).to_numpy().view(np.uint64)
            at = np.minimum(np.searchsorted(asked, term), len(asked) - 1)
            fit = asked[at] == term
            yield pa.RecordBatch.from_arrays([pa.array(at[fit].astype(np.int64)), b.column(1).filter(pa.array(fit))], ["at", "n"])

    out = np.zeros(len(kinds), np.int64)
    table = found.mapInArrow(pick, "at long, n long").toArrow()  # a row a term of the pass
    out[table["at"].to_numpy()] = table["n"].to_numpy()
    return out


def _asked(b: _Block, kinds: np.ndarray, mean_len: float) -> tuple[np.ndarray, ...]:
    """(ids, terms as places in ``kinds``, their counts, places of their postings, impacts) of a block, for those terms alone."""
    at = np.minimum(np.searchsorted(kinds, b.terms), max(0, len(kinds) - 1))
    own = np.flatnonzero(kinds[at] == b.terms)
    n = b.counts[own]
    post = np.repeat((np.cumsum(b.counts) - b.counts)[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    tf, place = b.tfs[post].astype(np.float64), b.posts[post]
    return b.docs, at[own].astype(np.int32), n, place, tf * (K1 + 1) / (tf + K1 * (1 - B + B * b.lens[place] / mean_len))


class _Shard:
    """The lists of a pass' terms over some blocks: entries by term and block, each with its postings and largest impact."""

    def __init__(self, blocks: list[tuple[np.ndarray, ...]], kinds: int):
        term, count, self.place, self.impact = (np.concatenate([b[i] for b in blocks]) for i in (1, 2, 3, 4))
        block = np.repeat(np.arange(len(blocks), dtype=np.int32), [len(b[1]) for b in blocks])
        first = (np.cumsum(count) - count).astype(np.int64)
        most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        order = np.argsort(term, kind="stable")
        self.term, self.block, self.first, self.count, self.most = (x[order] for x in (term, block, first, count, most))
        self.docs, self.size = [b[0] for b in blocks], len(blocks)
        self.starts = np.searchsorted(self.term, np.arange(kinds + 1, dtype=np.int32))
        # terms that many documents of a block have are added up as rows of a matrix
        self.slot, self.dense = np.full(len(order), -1, np.int32), []
        for b, ids in enumerate(self.docs):
            e = np.flatnonzero((self.block == b) & (self.count * DENSE >= len(ids)))
            self.slot[e] = np.arange(len(e))
            n = self.count[e]
            post = np.repeat(self.first[e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows = np.zeros((len(e), len(ids)))
            rows[np.repeat(np.arange(len(e)), n), self.place[post]] = self.impact[post]
            self.dense.append(rows)

    def entries(self, terms: np.ndarray) -> np.ndarray:
        """(blocks x terms): the entry of each, or -1."""
        out = np.full((self.size, len(terms)), -1, np.int32)
        start = self.starts[terms]
        n = self.starts[terms + 1] - start
        row = np.repeat(np.arange(len(terms)), n)
        entry = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[self.block[entry], row] = entry
        return out


def _walk(shard: _Shard, size: np.ndarray, terms: np.ndarray, weight: np.ndarray, top_score: np.ndarray, top_doc: np.ndarray) -> int:
    """Put what is better into the best scores and ids of each query, which have ``size`` terms each; how many blocks were scored."""
    seen, k = 0, top_score.shape[1]
    nq, end = len(size), shard.size
    who = np.repeat(np.arange(nq), size)
    entry = shard.entries(terms)
    most = np.where(entry >= 0, shard.most[entry], 0.0) * weight
    # a cursor's next block from each place on
    ahead = np.full((end + 2, len(terms)), end, np.int16)
    for b in range(end - 1, -1, -1):
        ahead[b] = np.where(entry[b] >= 0, b, ahead[b + 1])
    whole = most.max(0)

    def score(live: np.ndarray, b: int) -> None:
        """Score a block's documents for each live query."""
        nonlocal seen
        seen += len(live)
        row = np.full(nq, -1, np.int32)
        row[live] = np.arange(len(live))
        where, e = row[who], entry[b]
        here = np.flatnonzero((where >= 0) & (e >= 0))
        where, e = where[here], e[here]
        width, ids, slot = len(shard.docs[b]), shard.docs[b], shard.slot[e]
        many = np.flatnonzero(slot >= 0)
        weights = np.zeros((len(live), len(shard.dense[b])))
        weights[where[many], slot[many]] = weight[here[many]]
        few = np.flatnonzero(slot < 0)
        where, e = where[few], e[few]
        n = shard.count[e]
        post = np.repeat(shard.first[e] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        got = np.bincount(np.repeat(where * width, n) + shard.place[post], np.repeat(weight[here[few]], n) * shard.impact[post], len(live) * width)
        got = np.round(got.reshape(len(live), width) + weights @ shard.dense[b], DIGITS)
        best = got.max(1)
        better = np.flatnonzero((best >= top_score[live, -1]) & (best > 0))
        if not len(better):
            return
        rows = live[better]
        both = np.concatenate([top_score[rows], got[better]], 1)
        names = np.concatenate([top_doc[rows], np.broadcast_to(ids, (len(rows), width))], 1)
        order = np.lexsort((names, -both))[:, :k]
        top_score[rows], top_doc[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    bound = np.add.reduceat(most, np.cumsum(size) - size, axis=1)
    begun = np.where(top_score[:, -1] > 0, -1, bound.argmax(0))  # walks without a k-th score begin with their most promising block
    for b in np.unique(begun[begun >= 0]).tolist():
        score(np.flatnonzero(begun == b), b)
    cursor = ahead[0].copy()
    at = who * (end + 1)
    for b in range(end):  # every query's walk goes on where its pivot is this block
        need = top_score[:, -1] * (1 - 1e-9) - 10.0**-DIGITS
        # the lists' maxima by the place of their cursors; the pivot is where their sum first reaches what is needed
        mass = np.bincount(at + cursor, whole, nq * (end + 1)).reshape(nq, end + 1)[:, : b + 1].sum(1)
        here = np.flatnonzero((mass >= need) & (bound[b] >= need) & (bound[b] > 0) & (begun != b))
        if len(here):
            score(here, b)
        # cursors at a pivot go on; those of lists that only lag behind it wait, and are moved up to it when it is found
        moved = (mass >= need)[who]
        cursor = np.where(moved, np.maximum(cursor, ahead[b + 1]), cursor)
    return seen


def _best(index: DataFrame, found: DataFrame, q: _Queries, n_docs: int, mean_len: float, k: int) -> DataFrame:
    """query_id, doc_id, score: each shard's k best of every query."""
    df = _known(found, q.kinds)
    weight = q.tf * np.log1p((n_docs - df + 0.5) / (df + 0.5))[q.at]
    shared = index.sparkSession.sparkContext.broadcast((q, weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight = shared.value
        load = np.cumsum(q.size)
        top_score, top_doc = np.zeros((len(q.ids), k)), np.full((len(q.ids), k), np.iinfo(np.int64).max)

        def walk(blocks: list[tuple[np.ndarray, ...]]) -> None:
            shard, cut = _Shard(blocks, len(q.kinds)), 0
            while cut < len(q.ids):
                stop = max(cut + 1, int(np.searchsorted(load, q.first[cut] + CHUNK_PAIRS, "right")))
                span = slice(int(q.first[cut]), int(load[stop - 1]))
                _walk(shard, q.size[cut:stop], q.at[span], weight[span], top_score[cut:stop], top_doc[cut:stop])
                cut = stop

        held: list[tuple[np.ndarray, ...]] = []
        for b in _blocks(batches):
            if len(b.terms):
                held.append(_asked(b, q.kinds, mean_len))
            if len(held) == SHARD_BLOCKS:
                walk(held)
                held = []
        if held:
            walk(held)
        i, j = np.nonzero(top_score > 0)
        for s in range(0, len(i), 50_000):
            a, c = i[s : s + 50_000], j[s : s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[a]), pa.array(top_doc[a, c]), pa.array(top_score[a, c])], ["query_id", "doc_id", "score"])

    return index.mapInArrow(search, "query_id long, doc_id long, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of every row of ``queries`` (query_id, text)."""
    spark = docs.sparkSession
    stats = stage_table(build_index(docs, id_col, text_col), "index")
    # so many blocks a task, however many there are
    index = stats.coalesce(max(1, stats.count() // TASK_BLOCKS))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(x, np.int64) for x in column(batch, "lens")]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in got], pa.int64()), pa.array([int(x.sum()) for x in got], pa.int64())], ["n", "total"])

    n_docs, total = stats.select("lens").mapInArrow(lengths, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def kernel():
        def step(batch: pa.RecordBatch) -> dict:
            got = [terms_of(t) for t in column(batch, "text")]
            return {"query_id": column(batch, "query_id"), "terms": [g[0].tobytes() for g in got], "tfs": [g[1].tobytes() for g in got]}

        return step

    asked = stage_table(map_texts(queries.select("query_id", "text"), kernel, "query_id long, terms binary, tfs binary").filter(F.length("terms") > 0).filter("query_id is not null"), "queries")
    found = stage_table(frequencies(index), "frequencies")
    parts: list[DataFrame] = []
    held: list[tuple[int, bytes, bytes]] = []
    load = 0

    def run() -> None:
        parts.append(stage_table(_best(index, found, _Queries(held), n_docs, max(int(total), 1) / max(int(n_docs), 1), k), "best"))

    for row in asked.toLocalIterator():
        n = len(row["terms"]) // 8
        if held and (load + n > PASS_TERMS or len(held) == PASS_QUERIES):
            run()
            held, load = [], 0
        held.append((row["query_id"], bytes(row["terms"]), bytes(row["tfs"])))
        load += n
    if held:
        run()
    schema = "query_id long, rank int, doc_id long, score double"
    if not parts:
        return spark.createDataFrame([], schema)
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    # a row a shard, query and rank at most
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


#: BM25 of every hundredth document against all; A-Z are lower case, words are letters, digits and what is beyond ASCII.
SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents WHERE doc_id IS NOT NULL
), tf AS (
  SELECT doc_id, w, count(*)::DOUBLE AS tf FROM words GROUP BY doc_id, w
), lens AS (
  SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id
), totals AS (
  SELECT (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL)::DOUBLE AS n, (SELECT sum(len) FROM lens) AS total
), idf AS (
  SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf CROSS JOIN totals GROUP BY w, n
), scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * i.idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * l.len / (t.total / t.n)))), 6) AS score
  FROM tf q JOIN tf d ON q.w = d.w JOIN idf i ON i.w = q.w JOIN lens l ON l.doc_id = d.doc_id CROSS JOIN totals t
  WHERE q.doc_id % 100 = 0 GROUP BY q.doc_id, d.doc_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
