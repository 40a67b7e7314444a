"""The language stage tells the mixture what to take."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import langid, mixing
from palimpsest.llm.common import stage_table


def filled(sizes, target, power, cap):
    """Targets of one source's parts by rounds: whoever is above its cap is held there, the rest shares what is left."""
    held, open_ = {}, {k for k, n in sizes.items() if n}
    while open_:
        level = (target - sum(held.values())) / sum(sizes[k] ** power for k in open_)
        if not (above := {k for k in open_ if level * sizes[k] ** power > cap * sizes[k]}):
            break
        held |= {k: cap * sizes[k] for k in above}
        open_ -= above
    return dict.fromkeys(sizes, 0.0) | held | {k: level * sizes[k] ** power for k in open_}


@pytest.mark.parametrize(("share", "cap", "power"), [(1.5, 2.0, 0.7), (0.4, 1.0, 0.0), (0.8, 2.0, 1.0), (3.0, 2.0, 0.3)])
def test_parts_share_their_source(spark, share, cap, power):
    rng = random.Random(3)
    sizes = {(s, p): int(rng.paretovariate(0.5)) for s in (None, "", "a", "b", "c", "d") for p in [None, "", *(f"l{k}" for k in range(40))] if rng.random() < 0.8}
    sizes |= {("e", "none"): 0, ("f", "some"): 9, ("f", "none"): 0}
    rows = spark.createDataFrame([(*k, n) for k, n in sizes.items()], "source string, part string, size long").repartition(3)
    sources = stage_table(mixing.targets(rows, share=share, cap=cap), "sources")
    got = {(r.source, r.part): r for r in mixing.parts(sources, rows, power, cap).collect()}
    assert got.keys() == sizes.keys()
    for r in sources.collect():
        of = {p: n for (s, p), n in sizes.items() if s == r.source}
        want = filled(of, r.target, power, cap)
        assert sum(got[r.source, p].target for p in of) == pytest.approx(r.target)
        for p, n in of.items():
            assert got[r.source, p].source_size == n
            assert got[r.source, p].target <= cap * n
            assert got[r.source, p].target == pytest.approx(want[p])


def test_another_language_replaces_the_given_one(spark, docs, rows):
    """Where the text says so for sure, and the given one was learned; a language that wasn't can't be judged."""
    model = langid.train(docs)
    long = sorted(i for i, r in rows.items() if len(r.text or "") > 1000)
    wrong, strange = long[:20], long[20:25]
    turned = F.when(F.col("lang") == "en", "fr").otherwise("en")
    odd = docs.withColumn("lang", F.when(F.col("doc_id").isin(wrong), turned).when(F.col("doc_id").isin(strange), "xx").otherwise(F.col("lang")))
    given = {r.doc_id: r.lang for r in odd.collect()}
    told = {r.doc_id: r.lang for r in langid.determined(odd, model, sure=0.95).collect()}
    assert told.keys() == given.keys()
    assert sum(told[i] == rows[i].lang for i in wrong) >= 19
    assert all(told[i] == "xx" for i in strange)
    assert sum(told[i] != given[i] for i in given.keys() - set(wrong)) <= 0.01 * len(given)
    assert {r.doc_id: r.lang for r in langid.determined(odd, model).collect()} == given
    only = langid.LanguageModel(["en"], model.weights[:, :1], model.bias[:1])
    assert {r.doc_id: r.lang for r in langid.determined(odd, only, sure=0.95).collect()} == given


def copies(df):
    return Counter(r.doc_id for r in df.select("doc_id").collect())


@pytest.mark.parametrize("limit", [50_000, 0])
def test_stage_tells_the_mixture(spark, sf_dir, docs, rows, monkeypatch, limit):
    """What the mixture takes follows from the languages that the first stage told, not from those that the rows bear."""
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
    lettered = docs.filter(F.col("text").rlike(r"\p{L}")).withColumn("source", F.lit("all"))
    bare = lettered.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    told = stage_table(corpus_pipeline.language(spark, bare, sf_dir), "told")
    assert sum(r.lang == rows[r.doc_id].lang for r in told.collect()) >= 0.95 * len(rows)
    sizes = Counter()
    for r in told.collect():
        sizes[r.lang] += len(r.text.split())
    # all of one source at 1.5 times its size; smaller languages are taken up to twice
    want = filled(sizes, 1.5 * sum(sizes.values()), 0.7, 2.0)
    per = mixing.with_copies(told.withColumn("n", mixing.word_size(F.col("text"))), "copies", "n", part_col="lang")
    got = {r.lang: (r[1], r[2]) for r in per[0].groupBy("lang").agg(F.max(per[1]), F.max(per[2])).collect()}
    assert got == {k: (n, pytest.approx(want[k])) for k, n in sizes.items()}
    assert want["en"] / sizes["en"] < min(want[k] / sizes[k] for k in sizes if k != "en") <= 2
    taken = copies(corpus_pipeline.mix_sources(spark, told, sf_dir))
    assert taken == {r.doc_id: r.copies for r in per[0].collect() if r.copies}
    assert max(taken.values()) <= 2
    assert taken != copies(corpus_pipeline.mix_sources(spark, bare, sf_dir))
    assert taken != copies(mixing.mix(told))


def test_many_parts_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 50)
    rows = spark.range(100).selectExpr("id doc_id", "'one' source", "concat('l', id) lang", "3L n")
    out = mixing.with_copies(rows, "copies", "n", part_col="lang")[0]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.copies for r in out.collect()} == {1, 2}
    assert out.count() == 100
