"""Near duplicates, search, tokens, mixing, packing and the pipeline."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from palimpsest.llm import bpe_counts, mixing, neardup, packing, queries, topk
from palimpsest.llm.common import stage_table

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_sets(texts):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    return out


def brute_components(texts):
    sets, root = brute_sets(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def check_groups(df, texts):
    want, size = brute_components(texts)
    for r in neardup.near_duplicates(df).collect():
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (size[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates(docs, rows):
    check_groups(docs, {i: r.text for i, r in rows.items()})


def test_near_duplicates_odd(odd, empty):
    check_groups(odd, {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None})
    assert neardup.near_duplicates(empty).collect() == []
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids))
    assert None in ids
    assert 6 not in ids


def families(seed=11):
    """A chain whose ends aren't alike, a large family of near copies around a base, and pairs about the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = {}
    chain = [word() for _ in range(120)]
    for i in range(12):
        texts[len(texts)] = " ".join(chain)
        chain[10 * i : 10 * i + 6] = [word() for _ in range(6)]
    base = [word() for _ in range(150)]
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = word()
        texts[len(texts)] = " ".join(copy)
    for k in range(40):
        w = [word() for _ in range(60)]
        texts[len(texts)] = " ".join(w)
        w[:k] = [word() for _ in range(k)]
        texts[len(texts)] = " ".join(w)
    return texts


def test_near_duplicate_families(spark):
    texts = families()
    check_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts)


@pytest.mark.parametrize("most", [1 << 20, 64])
def test_small_blocks_and_filters(spark, monkeypatch, most):
    """Buckets of any size are compared whole, and full filters (64 bits) let more rows pass but change no result."""
    for name, value in (("BLOCK", 4), ("SHINGLES", 500), ("FEW_IDS", 2), ("MOST_BITS", most)):
        monkeypatch.setattr(neardup, name, value)
    texts = families(12)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, id string")
    check_groups(df, texts)
    want, _ = brute_components(texts)
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(i, texts[i]) for i, c in want.items() if i == c]


def test_id_levels_are_exact(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW_IDS", 5)
    rng = np.random.default_rng(4)
    ids = rng.choice(1 << 40, 5000, replace=False) - (1 << 39)
    frame = lambda x: spark.createDataFrame([(int(i),) for i in x], "id long")
    for cut in (4, 40, 2500, 4990):
        levels = neardup.id_levels(frame(ids[:cut]), frame(ids[cut:]))
        assert levels.sure
        assert (levels.named(ids) == (np.arange(len(ids)) < cut)).all()
        assert bool(levels.levels) == (cut > 5)


def test_repeated_ids_and_rows_without_one(spark):
    """An id's rows become one, the same in any order; rows without an id stand alone, even with another's text."""
    long = "one two three four five six seven eight nine ten"
    rows = [(1, long, "a"), (1, long + " eleven twelve thirteen fourteen", "b"), (2, long, "c"), (None, long, "d"), (None, long, "e"), (3, "else", "f"), (3, "else", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string")
    got = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False)] + [(3, 3, True)] * 2
    one = sorted(tuple(r) for r in neardup.deduplicated(df).fillna(0, "doc_id").collect())
    assert [r[0] for r in one] == [0, 0, 1, 3]
    assert one == sorted(tuple(r) for r in neardup.deduplicated(df.repartition(5)).fillna(0, "doc_id").collect())


def test_pruning_bounds():
    need = neardup.least_matches()
    assert need == sorted(need)
    n, m = 64, need[3]
    tail = lambda m: sum(math.comb(n + 1, k) * 0.75**k * 0.25 ** (n + 1 - k) for k in range(m + 1))
    assert tail(m) >= neardup.MISS > tail(m - 1)


def brute_search(texts, query, k=10):
    words = {i: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower()) for i, t in texts.items()}
    counts = {i: Counter(w) for i, w in words.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for c in counts.values() for w in c)
    out = []
    for i, c in counts.items():
        s = 0.0
        for w, q in counts[query].items():
            if f := c.get(w):
                s += q * math.log1p((len(words) - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        if s > 0:
            out.append((-s, i))
    return sorted(out)[:k]


def test_frequencies_are_counted_once_for_all_passes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {}
    for r in docs.collect():
        for t in topk.terms_of(r.text)[0].tolist():
            want[t] = want.get(t, 0) + 1
    assert {r.term % 2**64: r.n for r in topk.frequencies(topk.build_index(docs)).collect()} == want


@pytest.mark.parametrize(("terms", "shard"), [(topk.PASS_TERMS, 64), (300, 3)])
def test_search(docs, rows, monkeypatch, terms, shard):
    for name, value in (("PASS_TERMS", terms), ("BLOCK_DOCS", 16), ("SHARD_BLOCKS", shard), ("TASK_BLOCKS", 2 * shard)):
        monkeypatch.setattr(topk, name, value)
    asked = docs.filter("doc_id % 10 = 0").selectExpr("doc_id query_id", "text")
    got = defaultdict(list)
    for r in topk.search(docs, asked).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.doc_id))
    texts = {i: r.text for i, r in rows.items()}
    for q in (i for i in texts if i % 10 == 0):
        want = sorted((round(s, topk.DIGITS), d) for s, d in brute_search(texts, q, 40))[:10]
        assert [d for _, d in got[q]] == [d for _, d in want]
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want])


def test_search_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in queries.op3_topk_search(spark, sf_dir).collect()) == sorted(con.execute(topk.SEARCH_SQL).fetchall())


def test_walk_skips_blocks(docs, monkeypatch):
    """The walk finds what scoring every block finds, and scores fewer blocks."""
    monkeypatch.setattr(topk, "BLOCK_DOCS", 8)
    blocks = [topk._Block(r.asDict()) for r in topk.build_index(docs.coalesce(1)).collect()]
    assert len(blocks) > 20
    texts = [topk.terms_of(r.text) for r in docs.orderBy("doc_id").limit(30).collect() if r.text]
    q = topk._Queries([(i, t.tobytes(), n.tobytes()) for i, (t, n) in enumerate(texts) if len(t)])
    blocks = [topk._asked(b, q.kinds, 100.0) for b in blocks]
    shard = topk._Shard(blocks, len(q.kinds))
    rare = 1 / np.bincount(shard.term, shard.count, len(q.kinds))
    weight = q.tf * rare[q.at]
    score, doc = np.zeros((len(q.ids), 5)), np.full((len(q.ids), 5), np.iinfo(np.int64).max)
    seen = topk._walk(shard, q.size, q.at, weight, score, doc)
    assert seen < len(q.ids) * len(blocks) / 2
    one = []
    for b in blocks:
        one.append((np.zeros((len(q.ids), 5)), np.full((len(q.ids), 5), np.iinfo(np.int64).max)))
        topk._walk(topk._Shard([b], len(q.kinds)), q.size, q.at, weight, *one[-1])
    score_all, doc_all = (np.concatenate(x, 1) for x in zip(*one, strict=True))
    order = np.lexsort((doc_all, -score_all))[:, :5]
    assert (np.take_along_axis(doc_all, order, 1) == doc).all()
    assert np.allclose(np.take_along_axis(score_all, order, 1), score)


def test_search_odd(odd, empty):
    asked = odd.selectExpr("doc_id query_id", "text").filter("query_id is not null")
    got = topk.search(odd, asked).collect()
    assert {(r.query_id, r.doc_id) for r in got if r.query_id == 5 and r.rank == 1} == {(5, 5)}
    assert {r.query_id for r in got} == {i for i in range(4, 12)}
    assert topk.search(empty, asked).collect() == []


def odd_texts(n, alphabet, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 120))) for _ in range(n)]


def test_token_counts_match_the_library(rows):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [r.text for r in rows.values()] + odd_texts(3000, "aehinorst      \n\t.,-_=0123456789éñßü▁漢字😀<s>AB\0")
    texts += ["", " ", "  ", "\n", " \n ", "<s> </s> <unk> <0x0A>", *(" " * n + "x" + " " * (n // 2) for n in range(60)), *("ab" * n for n in range(40)), *("a" * n for n in range(40))]
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert bpe_counts.model(path).text_tokens(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_token_counts(odd, empty):
    got = {r.doc_id: r for r in bpe_counts.count_tokens(odd).collect()}
    assert (got[0].n_tokens, got[1].n_tokens, got[0].n_bytes) == (0, 0, 0)
    assert got[7].over_limit
    assert not got[4].over_limit
    assert bpe_counts.count_tokens(empty).collect() == []


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_chunk_tokens_match_the_library(rows):
    import public_tokenizers

    texts = [r.text for r in rows.values()] + odd_texts(3000, "abcÉéñß́ <|startoftext|>\n\t \x1c\x0b\xa0 'sßΣ!?09漢İKÀ×÷#&")
    tok = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in tok.encode(texts)] == library_ids(texts)


def check_packing(got, texts):
    ids = {i: [*x, 1] for i, x in zip(texts, library_ids([t or "" for t in texts.values()]), strict=True)}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert sorted(set(pieces[i])) == [(k, at, min(4096, len(x) - at)) for k, at in enumerate(range(0, len(x), 4096))]
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
    return len(seqs), sum(r.length for r in got)


def test_packing(docs, rows):
    n, total = check_packing(packing.pack_documents(docs).collect(), {i: r.text for i, r in rows.items()})
    assert n <= math.ceil(total / 4096) + 2


def test_packing_odd(odd, empty):
    every = packing.pack_documents(odd).collect()
    assert sum(r.doc_id is None for r in every) == 1
    assert len({(r.sequence_id, r.offset) for r in every}) == len(every)
    got = packing.pack_documents(odd.filter("doc_id is not null")).collect()
    check_packing(got, {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None})
    assert sum(r.doc_id == 5 for r in got) == 2
    assert packing.pack_documents(empty).collect() == []


def test_plans_use_every_piece():
    rng = random.Random(9)
    for _ in range(40):
        counts = {rng.randint(1, 64): rng.randint(1, 9) for _ in range(rng.randint(1, 40))}
        used = Counter()
        for shape, times in packing.plan(counts, 64):
            assert sum(shape) <= 64
            for n in shape:
                used[n] += times
        assert used == counts
    assert packing.plan({10: 4, 54: 4}, 64) == [((54, 10), 4)]
    assert packing.plan({32: 2, 16: 4}, 64) == [((32, 32), 1), ((16, 16, 16, 16), 1)]


def test_sums_are_those_of_pieces_that_are_left():
    """While counts fall, a sum is found if and only if one, two or three of the pieces have it."""
    rng = random.Random(4)
    for _ in range(30):
        have = np.zeros(41, np.int64)
        for _ in range(rng.randint(0, 9)):
            have[rng.randint(1, 40)] += rng.randint(1, 2)
        index = packing.SumIndex(have)
        while True:
            left = [int(n) for n in np.repeat(np.arange(41), have)]
            sums = {sum(c) for k in (1, 2, 3) for c in itertools.combinations(left, k)}
            for total in range(1, 41):
                got = index.exact(total)
                assert (got is not None) == (total in sums)
                assert got is None or (sum(got) == total and not Counter(got) - Counter(left))
            if not left:
                break
            have[rng.choice(left)] -= 1


@pytest.mark.parametrize(("share", "cap"), [(1.5, 2.0), (0.4, 1.0), (3.0, 2.0)])
def test_targets_of_many_sources(spark, share, cap):
    """Levels and places of thousands of sources, as a plain loop has them."""
    rng = random.Random(5)
    sizes = {f"host{i}": int(rng.paretovariate(0.6)) for i in range(3000)} | {None: 40, "": 0, "é": 7}
    plain = {s: [(5.0, 2.0, 1.0)[k % 3], cap * sizes[s]] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, target = share * sum(sizes.values()), dict(plain), {}
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = {s: m for s, (w, m) in open_.items() if m < level * w}
        if not full:
            target |= {s: level * w for s, (w, _) in open_.items()}
            break
        target |= full
        left, open_ = left - sum(full.values()), {s: x for s, x in open_.items() if s not in full}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(5)
    got = {r.source: r for r in mixing.targets(rows, share=share, cap=cap).collect()}
    assert got.keys() == sizes.keys()
    for s, r in got.items():
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s], rel=1e-12)


def test_mixing(spark, docs, odd, empty):
    for df in (docs, odd):
        got = mixing.mixture_report(df).collect()
        total = sum(r.size for r in got)
        source = {r.target: r.source_size for r in got}
        assert len(got) == df.count()
        assert all(r.target <= 2 * r.source_size and r.taken <= 2 * r.size for r in got)
        sizes = {r.doc_id: r for r in got}
        kinds = {}
        for r in df.collect():
            kinds[r.source] = sizes[r.doc_id]
        assert sum(x.target for x in kinds.values()) == pytest.approx(1.5 * total)
        assert source
        assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in mixing.mixture_report(df.repartition(3)).collect())
    assert mixing.mixture_report(empty).collect() == []
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    taken = Counter()
    for r in mixed.collect():
        taken[r.doc_id] += len((r.text or "").split())
    assert all(taken[r.doc_id] in (r.taken, 2 * r.taken) for r in mixing.mixture_report(odd).collect() if r.size)


@pytest.mark.parametrize("sources", [50_000, 0])
def test_mixture_keeps_any_column(odd, monkeypatch, sources):
    """Columns named like the helpers stay as they are."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    names = ("_size", "_words", "_copies", "_copy", "_target", "_source", "_source_size", "_salt", "_at", "__words", "a.b")
    wide = odd.selectExpr("*", *[f"concat('{n}', doc_id) `{n}`" for n in names])
    got = mixing.mix(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in names)
    assert sorted(r.doc_id or -1 for r in rows) == sorted(r.doc_id or -1 for r in mixing.mix(odd).collect())


def test_long_runs_are_linear():
    """Unbroken runs: the library's counts, within a small factor of its time."""
    import public_tokenizers
    import sentencepiece

    rng = random.Random(2)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, model = sentencepiece.SentencePieceProcessor(model_file=path), bpe_counts.model(path)
    runs = ["".join(rng.choices(a, k=400_000)) for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "acgt", "0123456789abcdef")]
    for t in [*runs, " " * 1_000_000, "a" * 300_000, "ab" * 100_000, "漢字" * 50_000]:
        began = time.monotonic()
        assert model.text_tokens([t]) == [len(library.encode(t))]
        assert time.monotonic() - began < 10


def test_salted_mixture(odd, monkeypatch):
    want = sorted((r.doc_id or -1, r.taken) for r in mixing.mixture_report(odd).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r.doc_id or -1, r.taken) for r in mixing.mixture_report(odd).collect()) == want


def test_mixture_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.REPORT_SQL})").fetchall())
    assert sorted(tuple(r) for r in queries.op9_mix(spark, sf_dir).collect()) == want


def test_pipeline(spark, sf_dir, docs, rows):
    """Against a plain version: no text goes but copies, secrets are masked, and what the mixture takes is packed whole."""
    import corpus_pipeline
    from palimpsest.llm import secrets

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixture", "packing"]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage_table(stage(spark, out, sf_dir), name)
        assert out.columns == docs.columns
    groups, _ = brute_components({i: r.text for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "")})
    kept = {i: secrets.redact(rows[i].text) for i, c in groups.items() if i == c}
    got = out.collect()
    assert {r.doc_id for r in got} <= set(kept)
    assert all(r.text == kept[r.doc_id] and r.n_chars == len(r.text) for r in got)
    copies = Counter(r.doc_id for r in got)
    assert max(copies.values()) <= 2
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    check_packing(packed, {i: kept[i] for i in copies})


def test_registered():
    want = {f"op{n}" for n in range(1, 11)}
    assert {n.split("_")[0] for n in queries.queries()} == want


def test_bands_are_shared_exactly_where_signatures_agree():
    """A pair is looked at in the first band in which its signatures agree; that band's bucket must hold both."""
    rng = np.random.default_rng(11)
    agreed = 0
    for _ in range(300):
        both = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        (a, x), (b, y) = (neardup.sketch_of(np.unique(np.r_[both, rng.integers(0, 1 << 63, 10, dtype=np.uint64)])) for _ in range(2))
        same = (a == b).reshape(neardup.BANDS, neardup.ROWS).all(1)
        agreed += same.sum()
        assert ((x == y) == same).all()
    assert agreed > 2000
    # bits that agree by chance make a shared key as well
    a = rng.integers(0, 1 << 16, neardup.HASHES, dtype=np.uint16)
    b = rng.integers(0, 1 << 16, neardup.HASHES, dtype=np.uint16)
    b[8:12] = a[8:12]
    assert (a.view(np.int64) == b.view(np.int64)).nonzero()[0].tolist() == [2]


def test_planted_pairs_share_a_band():
    """Of 10,000 pairs of similarity 0.75 and more none is without a band."""
    rng = np.random.default_rng(12)
    missed = 0
    for _ in range(10_000):
        both = rng.integers(0, 1 << 63, 84, dtype=np.uint64)
        x, y = (neardup.sketch_of(np.r_[both, rng.integers(0, 1 << 63, 14, dtype=np.uint64)])[1] for _ in range(2))
        missed += not (x == y).any()
    assert missed <= 1
