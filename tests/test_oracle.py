"""Every query of the main package against its SQL, on the smallest tables."""

import math
import re

import duckdb
import pandas as pd
import pytest

from palimpsest import plans
from palimpsest.sources.store import Store

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "-"
        return f"{v:.6g}" if isinstance(v, float) else str(v.item() if hasattr(v, "item") else v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, duck, sf_dir, name):
    got, want = plans.queries()[name](spark, sf_dir).toPandas(), duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create()
    assert store.read("memories").count() == 0
    store.append("memory_log", spark.sql("select 'create' op, '1' id, 'p' project, 'x' content, array('t') tags, timestamp_ntz'2024-01-01 00:00:00' ts"))
    assert store.read("memory_log").first().content == "x"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "project", "content", "score", "token_estimate"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_corpus_operations():
    from pathlib import Path

    root = Path(plans.__file__).parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"\bllm\b", p.read_text())]
