"""Unlabelled documents stay in the pipeline."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("lang", ["cast(null as string)", "if(upper(text) = lower(text), 'en', null)"])
def test_nothing_learned(spark, odd, sf_dir, lang):
    bare = odd.withColumn("lang", F.expr(lang))
    kept = corpus_pipeline.language(spark, bare, sf_dir)
    assert kept.columns == odd.columns
    want = sorted((r.doc_id or -1, r.text) for r in bare.collect() if any(c.isalpha() for c in r.text or ""))
    assert len(want) == 10
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == want
