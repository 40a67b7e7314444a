"""Ranked retrieval over memories.

The corpus is never exploded for a query: its tokens are literals of the plan, looked
for in one pass over each text. A document leaves one count per query token and, where
there is a hit, its length; statistics and the ranking, a top-k per task merged once,
come from that narrow table, and only the answer's own texts are read again.
"""

from __future__ import annotations

from collections import Counter
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import moment, recency
from ..functions.text import forms, found, has_tokens, token_count, token_estimate, tokens, tokens_of
from ..sources.store import discard, stage_table

#: Tokens that any answer costs besides its memories.
OVERHEAD = 40
#: Ranked by text before recency has its say, as a multiple of k.
OVERFETCH = 3


def clamp(k: int, most: int = 20) -> int:
    return max(1, min(most, k))


def active(memories: DataFrame) -> DataFrame:
    return memories.filter(~F.col("forgotten"))


def term_frequencies(memories: DataFrame) -> DataFrame:
    """(id, token, tf)."""
    return memories.select("id", F.explode(tokens(F.col("content"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def document_frequencies(memories: DataFrame) -> DataFrame:
    """(token, df): each document counts a token once, so one shuffle on the token is enough."""
    return memories.select(F.explode(F.array_distinct(tokens(F.col("content")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    return F.ln((n + 1) / (df + 1)) + 1


def inverse_frequencies(memories: DataFrame) -> DataFrame:
    """(token, df, idf), smoothed; documents without tokens don't count."""
    n = memories.agg(F.count_if(has_tokens(F.lower("content"))).alias("n"))
    return document_frequencies(memories).crossJoin(F.broadcast(n)).select("token", "df", idf(F.col("df"), F.col("n")).alias("idf"))


def _counted(memories: DataFrame, words: list[str]) -> DataFrame:
    """``memories`` with _docs (1 if there are tokens), _n (tokens, where a word is found) and _c0, _c1, ...: how often each word occurs."""
    rows = memories.withColumn("_low", F.lower("content")).withColumn("_found", found(F.col("_low"), words))
    times = lambda w: F.size(F.filter("_found", lambda f: f.isin(forms(w))))
    rows = rows.withColumns({f"_c{i}": times(w) for i, w in enumerate(words)})
    hit = F.size("_found") > 0
    return rows.withColumn("_n", F.when(hit, token_count(F.col("_low")))).withColumn("_docs", (hit | has_tokens(F.col("_low"))).cast("int")).drop("_low", "_found")


def _weighed(counted: DataFrame, over: DataFrame, asked: Counter) -> DataFrame:
    """Those with a hit, with their score: weights are from the frequencies in ``over``, which is counted too."""
    stats = over.agg(F.sum("_docs").alias("_all"), *[F.count_if(F.col(f"_c{i}") > 0).alias(f"_df{i}") for i in range(len(asked))])
    total, parts = sum(asked.values()), []
    for i, n in enumerate(asked.values()):
        weight = idf(F.col(f"_df{i}"), F.col("_all"))
        parts.append(F.col(f"_c{i}") / F.col("_n") * F.lit(n / total) * weight * weight)
    rows = counted.filter("_n IS NOT NULL").crossJoin(F.broadcast(stats))  # one row of statistics
    # every weight is above 0, so a hit is a score above 0
    return rows.withColumn("score", reduce(lambda a, b: a + b, parts))


def _answer(memories: DataFrame, best: list[tuple]) -> DataFrame:
    """The memories of a few (id, score): their rows alone are read, by their ids."""
    kind = memories.schema["id"].dataType.simpleString()
    scores = memories.sparkSession.createDataFrame([tuple(b) for b in best], f"id {kind}, score double")
    rows = memories.filter(F.col("id").isin([b[0] for b in best])) if best else memories.limit(0)
    return rows.join(F.broadcast(scores), "id").orderBy(F.desc("score"), "id").select("id", "project", "content", F.round("score", 5).alias("score"), token_estimate(F.col("content")).alias("token_estimate"))


def _top(memories: DataFrame, query: str, k: int, project: str | None = None, again: int = 0, boost: Column | None = None) -> list[tuple]:
    """(id, score) of the k best, ``again`` of them ranked anew by a boosted score. All texts are read once; a narrow table of counts gives statistics and ranks."""
    asked = Counter(tokens_of(query))
    if not asked:
        return []
    counted = stage_table(_counted(memories.select("id", "project", "content", "created_at"), list(asked)).drop("content"), "counts")
    inside = counted if project is None else counted.filter(F.col("project") == project)
    best = _weighed(inside, counted, asked).select("id", "score", "created_at").orderBy(F.desc("score"), "id").limit(again or k)
    if boost is not None:
        best = best.withColumn("score", F.col("score") * boost).orderBy(F.desc("score"), "id").limit(k)
    out = [(r["id"], r["score"]) for r in best.collect()]  # k rows
    discard(counted)
    return out


def recall(memories: DataFrame, query: str, now: datetime | str, project: str | None = None, k: int = 5, recency_weight: float = 0.3) -> DataFrame:
    """The k best memories. Frequencies are those of all active memories, whatever the project.

    Ties go to the smaller id; scores are ranked before they are rounded.
    """
    k, w = clamp(k), max(0.0, min(1.0, recency_weight))
    held = active(memories)
    boost = 1 + w * recency(F.col("created_at"), now) if w > 0 else None
    return _answer(held, _top(held, query, k, project, OVERFETCH * k if w > 0 else 0, boost))


def budget(answer: DataFrame) -> DataFrame:
    """(count, total_tokens) of an answer."""
    return answer.agg(F.count("*").alias("count"), (F.lit(OVERHEAD) + F.coalesce(F.sum("token_estimate"), F.lit(0))).alias("total_tokens"))


def answer_at(memories: DataFrame, versions: DataFrame, query: str, timestamp: str, project: str | None = None, k: int = 5) -> DataFrame:
    """(as_of, count, total_tokens, error): what ``query_at`` costs; nothing and a reason for a bad timestamp, nothing for a blank query."""
    spark = memories.sparkSession
    reason = None if moment(timestamp) is not None else f"Invalid ISO 8601 timestamp: '{timestamp}'"
    if reason or not query.strip():
        return spark.createDataFrame([(timestamp, 0, 0, None if not query.strip() else reason)], "as_of string, count long, total_tokens long, error string")
    out = budget(query_at(memories, versions, query, timestamp, project, k))
    return out.select(F.lit(timestamp).alias("as_of"), "count", F.col("total_tokens").cast("long").alias("total_tokens"), F.lit(None).cast("string").alias("error"))


def query_at(memories: DataFrame, versions: DataFrame, query: str, timestamp: str, project: str | None = None, k: int = 5) -> DataFrame:
    """The k best memories of a past moment; frequencies are those of the snapshot. A bad timestamp raises ValueError."""
    from .versions import snapshot

    when = moment(timestamp)
    if when is None:
        raise ValueError(f"not an ISO 8601 timestamp: {timestamp!r}")
    held = memories if project is None else memories.filter(F.col("project") == project)
    past = snapshot(held, versions, when)
    return _answer(past, _top(past, query, clamp(k)))
