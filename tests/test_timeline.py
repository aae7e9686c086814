"""Joins along time against loops over all pairs; pages of changes with equal times, late rows and lost runs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from foliospark.operators import eav, timeline
from foliospark.sources.incremental import Puller, pull_all

T0 = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else T0 + timedelta(minutes=minutes)


def test_interval_join(spark):
    draw = random.Random(1)
    points = [(draw.choice(["hot", "hot", "a", None]), i, draw.choice([None, *range(0, 90000, 30)])) for i in range(300)]
    spans = []
    for i in range(120):
        s = draw.randrange(0, 90000, 30)
        spans.append((draw.choice(["hot", "hot", "a", None]), 1000 + i, draw.choice([None, s, s, s]), draw.choice([None, s, s + 30, s + draw.randrange(60, 60000, 30)])))
    want = sorted((p[1], s[1]) for p in points for s in spans if p[0] is not None and p[0] == s[0] and p[2] is not None and s[2] is not None and s[2] <= p[2] and (s[3] is None or p[2] < s[3]))
    left = spark.createDataFrame([(k, i, at(m)) for k, i, m in points], "k string, point int, at timestamp")
    right = spark.createDataFrame([(k, i, at(a), at(b)) for k, i, a, b in spans], "k string, span int, since timestamp, until timestamp")
    met = timeline.interval_join(left, right, "k", "at", "since", "until")
    assert sorted((r["point"], r["span"]) for r in met.collect()) == want and len(want) > 500
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    outer = timeline.interval_join(left, right, "k", "at", "since", "until", how="left").select("point", "span").collect()
    alone = {p[1] for p in points} - {p for p, _ in want}
    assert sorted((r["point"], r["span"]) for r in outer if r["span"] is not None) == want
    assert sorted(r["point"] for r in outer if r["span"] is None) == sorted(alone)
    assert timeline.interval_join(left, right.where("false"), "k", "at", "since", "until", how="left").count() == 300


def test_as_of(spark):
    draw = random.Random(2)
    left = [(draw.choice(["hot", "hot", "a", None]), draw.choice([None, *range(0, 9000, 60)]), i) for i in range(200)]
    right = [(draw.choice(["hot", "hot", "a", None]), draw.choice([None, *range(0, 9000, 60)]), i, f"v{i}") for i in range(150)]
    def last(k, t):
        fits = [(r[1], r[2], r[3]) for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and r[1] <= t]
        return max(fits)[2] if fits else None
    out = timeline.as_of(spark.createDataFrame([(k, at(t), i) for k, t, i in left], "k string, t timestamp, i int"), spark.createDataFrame([(k, at(t), i, v) for k, t, i, v in right], "k string, s timestamp, tie int, v string"), "k", "t", "s", "tie", ["v"])
    assert out.columns == ["k", "t", "i", "v"]
    assert sorted((r["i"], r["v"]) for r in out.collect()) == sorted((i, last(k, t)) for k, t, i in left)


def test_status_history(spark):
    rows = [("d", "uploaded", 0, 1), ("d", "processing", 5, 2), ("d", "processing", 9, 3), ("d", "completed", 2000, 4), ("d", "uploaded", 2000, 5), ("e", None, 1, 6), ("e", "deleted", 3, 7), (None, "uploaded", 2, 8), ("d", "failed", None, 9)]
    events = spark.createDataFrame([(d, s, at(t), i) for d, s, t, i in rows], "document_id string, status string, at timestamp, event_id int")
    history = timeline.status_history(events)
    got = sorted([(r["document_id"] or "", r["was"], r["status"], r["valid_from"], r["valid_to"], r["legal"]) for r in history.collect()], key=str)
    assert got == sorted([
        ("d", None, "uploaded", at(0), at(5), True), ("d", "uploaded", "processing", at(5), at(2000), True), ("d", "processing", "completed", at(2000), at(2000), True), ("d", "completed", "uploaded", at(2000), None, False),
        ("e", None, None, at(1), at(3), False), ("e", None, "deleted", at(3), None, False), ("", None, "uploaded", at(2), None, True)], key=str)
    seconds = {(r["document_id"], r["status"]): r["seconds"] for r in timeline.time_in_status(history, F.lit("2024-01-03 00:00:00")).collect()}
    assert seconds[("d", "processing")] == 1995 * 60 and seconds[("d", "uploaded")] == 300 + (2880 - 2000) * 60
    times = {r["document_id"]: (r["status"], r["started_at"], r["completed_at"]) for r in timeline.status_times(events.where("at is not null")).collect()}
    assert times["d"] == ("uploaded", at(5), at(2000)) and times["e"] == ("deleted", None, None)


def test_thousand_rows_of_one_time_and_late_ones(spark, tmp_path):
    rows = [(i, at(0)) for i in range(1000)] + [(2000 + i, at(i)) for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "document_id long, updated_at timestamp")
    puller = Puller(spark, f"{tmp_path}/p", overlap="30 minutes")
    assert [puller.pull(docs, 300) for _ in range(4)] == [300, 300, 300, 139] and puller.pull(docs, 300) == 0
    late = docs.union(spark.createDataFrame([(7000, at(20)), (7001, at(1)), (7002, None), (None, at(50)), (7003, at(60))], docs.schema))
    assert puller.pull(late, 300) == 2 and puller.pull(late, 300) == 0  # 7001 is later than the overlap allows
    got = [r["document_id"] for r in puller.pulled().collect()]
    assert sorted(got) == sorted([i for i, _ in rows] + [7000, 7003])
    assert puller.cursor()[1:] == (at(60), 7003)


def test_a_page_without_its_cursor_is_written_again(spark, tmp_path):
    docs = spark.createDataFrame([(i, at(i // 10)) for i in range(50)], "document_id long, updated_at timestamp")
    path = f"{tmp_path}/p"
    Puller(spark, path).pull(docs, 20)
    docs.limit(3).write.parquet(f"{path}/pages/page=1")  # what a lost run left
    assert Puller(spark, path).pulled().count() == 20
    whole = pull_all(spark, docs, path, 20)
    assert sorted(r["document_id"] for r in whole.collect()) == list(range(50))


def test_mapped_keeps_documents_without_fields(spark):
    rows = spark.createDataFrame([(1, "a_b", "x"), (2, "c_d", "y")], "document_id int, field_name string, field_value string")
    out = eav.mapped(rows, {"s": {"t": "a.b", "odd": {"transform": "z", "fields": ["a.b"]}}}, "s")
    assert sorted(map(tuple, out.collect())) == [(1, "x", None), (2, None, None)]
