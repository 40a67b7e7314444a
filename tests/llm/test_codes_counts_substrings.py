"""Vector codes, dominance counts and substring dedup against SQL, brute force and odd input."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import dominance, queries, substrings, vectorcodes

NEW = ("op11_vector_codes", "op12_dominance", "op13_substrings")


@pytest.mark.parametrize("name", NEW)
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "sales"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.queries()[name](spark, sf_dir).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    key = got.columns[0]
    plain = lambda df: df[sorted(df.columns)].sort_values(key).astype(object).where(lambda x: x.notna(), None).values.tolist()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


# -- dominance -------------------------------------------------------------------------------------------------------


def brute_above(rows):
    out = []
    for slot, level, _ in rows:
        if slot is None or level is None:
            out.append((None, None))
            continue
        over = [w for s, v, w in rows if s is not None and v is not None and s < slot and v > level]
        out.append((len(over), sum(over)))
    return out


def check_above(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, slot long, n_above long, w long").withColumnRenamed("n_above", "_slot")
    got = dominance.dominating(df, F.col("slot"), F.col("_slot"), F.col("w")).orderBy("id").collect()
    assert [(r.n_above, r.w_above) for r in got] == brute_above(rows)
    assert got[0].asDict().keys() == {"id", "slot", "_slot", "w", "n_above", "w_above"}


@pytest.mark.parametrize("levels", [3, 300, 100_000])
def test_dominance_brute_force(spark, levels):
    rng = random.Random(levels)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, rng.randrange(-levels, levels)]), rng.randrange(1, 6)) for _ in range(1500)]
    rows += [(7, 5, 2)] * 300 + [(7, rng.randrange(levels), 1) for _ in range(500)]  # a hot cell, a hot slot
    check_above(spark, rows)


def test_dominance_over_the_whole_range_of_longs(spark):
    big = 1 << 63
    check_above(spark, [(s, v, 1) for s, v in ((0, big - 1), (1, -big), (2, 0), (3, -1), (4, big - 2), (4, -big), (5, -big))])


def test_dominance_hands_counts_on_between_tasks(spark):
    """One prefix over many tasks: as many ranges as the session has partitions."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(1)
        check_above(spark, [(s, rng.randrange(200), 1 + s % 3) for s in range(1200)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dominance_empty_and_null(spark):
    none = spark.createDataFrame([], "slot long, level long")
    assert dominance.dominating(none, F.col("slot"), F.col("level")).collect() == []
    nulls = spark.createDataFrame([(None, 1), (2, None)], "slot long, level long")
    assert [tuple(r)[2:] for r in dominance.dominating(nulls, F.col("slot"), F.col("level")).collect()] == [(None, None)] * 2


def test_sales_odd(spark):
    rows = [(1, "2024-01-01 00:00:59", 10.0), (1, "2024-01-01 00:00:59", 10.0), (2, "2024-01-01 00:01:00", 9.994), (3, "1969-12-31 23:59:59", float("nan")), (None, "2024-01-02 00:00:00", 0.005), (4, None, 3.0), (5, "2024-01-03 00:00:00", float("inf"))]
    df = spark.createDataFrame(rows, "sale_id long, at string, total double").select("sale_id", F.col("at").cast("timestamp_ntz").alias("sold_at"), "total", F.lit(1).alias("slot"))
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = sorted(map(tuple, dominance.sales_above(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    weight = 1 + zlib.crc32(b"1") % 5
    first = 1704067200 // 60
    want = [(1, first, 1000, 0, 0)] * 2 + [(2, first + 1, 999, 2, 2 * weight), (3, -1, None, None, None), (4, None, 300, None, None), (5, first + 2880, None, None, None)]
    assert got[:-1] == sorted(want, key=str)
    assert got[-1][:3] == (None, first + 1440, 1) and got[-1][3] == 3


# -- vector codes ----------------------------------------------------------------------------------------------------


def brute_codes(vectors, entries=16, rounds=6):
    q = {i: [int(np.floor(4096 * float(np.float32(x)))) for x in v] for i, v in vectors.items()}
    ids, width = sorted(q), len(next(iter(q.values()))) // 8
    part = lambda i, p: q[i][p * width : (p + 1) * width]
    books = [[part(i, p) for i in ids[:entries]] for p in range(8)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            members = {}
            for i in ids:
                members.setdefault(nearest(p, part(i, p))[1], []).append(part(i, p))
            books[p] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    best = {i: [nearest(p, part(i, p)) for p in range(8)] for i in ids}
    text = ",".join(str(c) for b in books for e in b for c in e)
    return {i: ("".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b)) for i, b in best.items()}, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("n", [5, 16, 90])
def test_codes_brute_force(spark, n):
    rng = np.random.default_rng(n)
    vectors = {i * 3: rng.normal(0, 1, 16).astype(np.float32).round(1).tolist() for i in range(n)}
    vectors[300] = vectors[0]  # ties
    rows = [(i, v, i % 4 if i % 5 else None) for i, v in vectors.items()]
    rows += [(1, None, 1), (2, [float("nan")] * 16, 1), (4, [1.0] * 15 + [None], 1), (5, [], 1), (7, [float("inf")] + [0.0] * 15, None), (999, [1.0] * 8, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("id", F.lit(0))
    want, digest = brute_codes(vectors)
    per = {}
    for i, _, label in rows:
        if i in want:
            per[label] = per.get(label, 0) + want[i][1]
    got = vectorcodes.compressed(df).collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want
    assert all(r.codebooks_sha256 == digest and r.label_error == per[dict((i, x) for i, _, x in rows)[r.vec_id]] for r in got)


def test_codes_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    book = vectorcodes.Book(rng.integers(-2000, 2000, (8, 16, 8)))
    x = rng.integers(-2500, 2500, (500, 8))
    lower, upper = book.bounds(x, 2)
    exact = ((x[:, None] - book.entries[2]) ** 2).sum(2)
    assert (lower <= exact).all() and (exact <= upper).all()
    assert (lower <= upper.min(1, keepdims=True)).mean() < 0.5
    code, far = book.nearest(x, 2)
    assert (code == exact.argmin(1)).all() and (far == exact.min(1)).all()


def test_codes_odd(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectorcodes.compressed(empty).collect() == []
    assert vectorcodes.compressed(spark.createDataFrame([(1, None, 1)], empty.schema)).collect() == []
    same = spark.createDataFrame([(None, [0.5] * 8, None), (1, [0.25] * 8, None), (1, [0.25] * 8, None)], empty.schema)
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in vectorcodes.compressed(same).collect()) == [(0, "02" * 8, 0, 0), (1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0)]
    book = vectorcodes.learn(same)
    assert vectorcodes.decode(vectorcodes.encode(same, book), book).filter("vec_id is null").first().approx == [0.5] * 8


# -- substrings ------------------------------------------------------------------------------------------------------


def brute_kept(texts):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    first = {}
    for i, w in sorted(words, key=lambda x: (x[0] is None, x[0])):
        for k in range(len(w) - 19):
            place = ((i is None, i or 0), k)
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, place), place)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < ((i is None, i or 0), k):
                gone |= set(range(k, k + 20))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def check_kept(spark, texts):
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, _doc int")
    assert sorted(map(tuple, substrings.report(df).collect()), key=str) == brute_kept(texts)


def passages(seed, n=60, words=12):
    rng = random.Random(seed)
    shared = [" ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(15, 60))) for _ in range(6)]
    return [(i, "  ".join(rng.choice([*shared, *[f"u{rng.randrange(400)}" for _ in range(6)]]) for _ in range(rng.randrange(0, 25)))) for i in rng.sample(range(1000), n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_brute_force(spark, seed):
    check_kept(spark, passages(seed))


def test_substrings_small_blocks_and_bounds(monkeypatch):
    """Blocks of a few documents and groups that are settled again and again give the same."""
    monkeypatch.setattr(substrings, "LEAVES", 50)
    texts = passages(7)
    trees, lost = {}, set()
    for k in range(0, len(texts), 7):
        part = texts[k : k + 7]
        words = [substrings.word_hashes(np.frombuffer(t.encode(), np.uint8), substrings._GAP) for _, t in part]
        keep = [i for i, w in enumerate(words) if len(w) >= 20]
        done = substrings.block_suffixes(np.array([part[i][0] for i in keep]), np.zeros(len(keep), np.int32), [words[i] for i in keep], 3) if keep else []
        for group, blob in done:
            tree = trees.setdefault(group, substrings.Subtrees())
            lost |= ranges(tree.add(blob))
            if tree.held > tree.bound:
                lost |= ranges(tree.settle(last=False))
    for tree in trees.values():
        lost |= ranges(tree.settle(last=True))
    for i, total, gone, _ in brute_kept(texts):
        runs = [(s, 1) for d, s in lost if d == i]
        n, kept = substrings.kept_words(dict(texts)[i], runs)
        assert (n, n - len(kept)) == (total, gone)


def ranges(found):
    return {(d, s + j) for d, s, n in zip(*(found[c].tolist() for c in ("doc", "start", "run")), strict=True) for j in range(n)}


def test_substrings_odd(spark, odd, empty):
    line = " ".join(f"a{i}" for i in range(30))
    texts = [(3, line), (3, line), (3, f"x {line}"), (None, line), (None, None), (2, "é " + line), (9, "b " * 70_000), (10, None), (11, ""), (12, " \t\n"), (13, line + " " + line), (-5, "a1 a2")]
    check_kept(spark, texts)
    assert substrings.report(empty).collect() == [] and substrings.deduplicated(empty).collect() == []
    kept = substrings.deduplicated(odd)
    assert kept.columns == odd.columns and kept.schema == odd.schema
    assert sorted(r.text or "" for r in kept.collect()) == sorted(r.text or "" for r in odd.collect())
    both = spark.createDataFrame([(1, line, 9, "p"), (2, "q " + line, 9, None)], "doc_id long, text string, n_chars long, _runs string")
    assert sorted((r.doc_id, r.text, r.n_chars, r._runs) for r in substrings.deduplicated(both).collect()) == [(1, line, 9, "p"), (2, "q", 1, None)]
