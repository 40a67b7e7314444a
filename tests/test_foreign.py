"""Bodies of other systems as events, titles and tenants, on odd input."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.text import normalised
from palimpsest.sources import foreign


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def bodies(spark, *items):
    return spark.createDataFrame([(x if isinstance(x, str) or x is None else json.dumps(x), i) for i, x in enumerate(items)], "body string, delivery_id int")


def rows(df):
    return sorted(((r.aggregate_id, r.event_type, r.ts, json.loads(r.payload), json.loads(r.metadata)) for r in df.collect()), key=str)


def test_pull_requests(spark, zone):
    pr = {"id": 7, "title": "T", "state": "open", "additions": 3, "deletions": None, "created_at": "2024-03-01T10:00:00Z", "user": {"login": "u"}}
    df = foreign.pull_requests(bodies(spark, {"action": "opened", "repository": {"id": 5}, "pull_request": pr}, {"action": "closed", "pull_request": {**pr, "created_at": "2024-03-01T10:00:00+02:00"}}, {"action": "opened", "pull_request": {**pr, "created_at": "never"}}, {"action": "opened"}, "{not json", "", None), "t")
    (a, b) = rows(df)
    assert a[:3] == ("node:t:pr_7", "node_created", datetime(2024, 3, 1, 10)) and b[:3] == ("node:t:pr_7", "node_updated", datetime(2024, 3, 1, 8))
    assert a[3] == {"node_type": "pull_request", "attributes": {"title": "T", "state": "open", "additions": 3, "deletions": None, "author": "u"}, "relations": [{"target": "node:t:repo_5", "type": "belongs_to"}]}
    assert a[4] == {"source": "github_webhook", "delivery_id": "0", "tenant_id": "t"}
    assert {len(r.event_id) for r in df.collect()} == {36} and {r.schema_version for r in df.collect()} == {"2.3"}


def test_issues_count_once_a_revision(spark, zone):
    fields = {"summary": "S", "status": {"name": "open"}, "priority": {"name": "high"}, "assignee": None, "created": "2024-03-01T10:00:00.000+0000", "updated": "2024-03-01T10:00:00.000+0000", "customfield_10016": 2.5}
    later = {**fields, "updated": "2024-03-02T10:00:00.000+0000", "assignee": {"displayName": "A"}}
    got = rows(foreign.issues(bodies(spark, *[{"id": "9", "key": "K-9", "fields": f} for f in (fields, fields, later)], {"id": "9"}, {"key": "K"}, None), "t"))
    assert [g[:3] for g in got] == [("node:t:jira_9", "node_created", datetime(2024, 3, 1, 10)), ("node:t:jira_9", "node_updated", datetime(2024, 3, 2, 10))]
    assert got[0][3] == {"node_type": "jira_issue", "attributes": {"key": "K-9", "summary": "S", "status": "open", "priority": "high", "story_points": 2.5, "assignee": None}}
    assert got[1][3]["attributes"]["assignee"] == "A"


def test_messages(spark, zone):
    event = {"type": "message", "ts": "1709287200.000100", "text": "hi", "user": "U1", "channel": "C", "team": "T"}
    got = rows(foreign.messages(bodies(spark, *[{"event": e} for e in (event, {**event, "type": "reaction_added", "reaction": "+1", "user": None, "text": None}, {**event, "bot_id": "B"}, {**event, "subtype": "join"}, {**event, "ts": "x"}, {**event, "ts": None})], {"type": "url_verification"}), "t"))
    moment = datetime(2024, 3, 1, 10, 0, 0, 100)
    assert [g[:3] for g in got] == [("node:t:slack_1709287200.000100", "node_created", moment), ("node:t:slack_1709287200.000100", "relation_added", moment)]
    assert got[0][3]["relations"] == [{"target": "node:t:slack_user_U1", "type": "authored_by"}, {"target": "node:t:slack_channel_C", "type": "posted_in"}]
    assert got[1][3]["attributes"] == {"text": "", "user": None, "channel": "C", "reaction": "+1", "thread_ts": None}
    assert got[0][4] == {"source": "slack_events_api", "team_id": "T", "tenant_id": "t"}


def test_tenants_see_their_own(spark):
    events = spark.createDataFrame([(1, '{"tenant_id": "a"}'), (2, '{"tenant_id": "b"}'), (3, "{}"), (4, None), (5, "broken"), (6, '{"tenant_id": null}')], "id int, metadata string")
    assert [r.id for r in foreign.of_tenant(events, "a").collect()] == [1]
    assert foreign.of_tenant(events, None).count() == foreign.of_tenant(events, "").count() == 0


def test_titles(spark):
    rows = [("  Ünïcode Łódź ", "unicode odz"), ("ŠTRÖM\t", "strom"), ("日本 Title", "title"), ("", ""), (None, None), ("Ấp ẞ", "ap"), ("a\xa0b", "ab")]
    got = spark.createDataFrame(rows, "title string, want string").select(normalised(F.col("title")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
