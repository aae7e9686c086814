"""Steps that are run again, and days of reports that are written again."""

import os

import pytest
from pyspark.sql import functions as F

from foliospark.operators import reports
from foliospark.plans.steps import Steps


def seen(spark, path, name):
    return {n: sorted(r[0] for r in spark.read.parquet(f"{path}/{name}/run={n}").select("document_id").collect()) for n in range(9) if os.path.isdir(f"{path}/{name}/run={n}")}


def test_a_failure_in_the_second_of_three_steps_reruns_its_documents_only(spark, tmp_path):
    path = str(tmp_path)
    def steps(broken):
        plain = lambda t: t["documents"].select("document_id", F.lit(None).cast("string").alias("error"))
        middle = lambda t: t["a"].select("document_id", F.when(F.col("document_id").isin(*broken), "odd").alias("error"))
        return Steps(spark, path).add("a", plain).add("b", middle, ["a"]).add("c", lambda t: t["b"].select("document_id", F.lit(None).cast("string").alias("error")), ["b"])
    docs = spark.createDataFrame([(i,) for i in range(6)], "document_id int")
    assert steps([2, 4]).run(docs) == 0 and steps([4]).run(docs) == 1
    assert seen(spark, path, "a") == {0: list(range(6)), 1: []}
    assert seen(spark, path, "b") == {0: list(range(6)), 1: [2, 4]}
    assert seen(spark, path, "c") == {0: [0, 1, 3, 5], 1: [2]}
    state = {(r["document_id"], r["step"]): (r["state"], r["attempts"], r["run"]) for r in steps([]).manifest().collect()}
    assert state[4, "b"] == ("failed", 2, 1) and state[2, "b"] == ("done", 2, 1) and (4, "c") not in state and state[0, "c"] == ("done", 1, 0)


def test_a_lost_run_is_done_again(spark, tmp_path):
    def fails(t):
        raise OSError("lost")
    good = lambda t: t["documents"].select("document_id", F.lit(None).cast("string").alias("error"))
    docs = spark.createDataFrame([(1,), (2,)], "document_id int")
    with pytest.raises(OSError, match="lost"):
        Steps(spark, str(tmp_path)).add("a", good).add("b", fails, ["a"]).run(docs)
    own = Steps(spark, str(tmp_path)).add("a", good).add("b", good, ["a"])
    own.run(docs)
    assert own.results("b").count() == 2 and own.results("a").count() == 2
    with pytest.raises(ValueError, match="unknown"):
        own.add("x", good, ["nothing"])


def test_other_days_are_left_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-0{1 + i % 3} 10:00:00", i % 2, i, float(i), i % 5 == 0) for i in range(60)], "at string, engine int, user_id long, seconds double, failed boolean")
    reports.write_state(rows, str(tmp_path), ["engine"])
    def files():
        return {f: os.path.getmtime(os.path.join(p, f)) for p, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet") and "2024-01-02" not in p}
    before = files()
    reports.write_state(rows.where("at < '2024-01-03' and at > '2024-01-02' and user_id < 10"), str(tmp_path), ["engine"])
    assert files() == before
    got = {r["day"].day: r for r in reports.state_report(spark.read.parquet(str(tmp_path)), ["day"], {"median": 0.5}).collect()}
    assert [got[k]["jobs"] for k in (1, 2, 3)] == [20, 3, 20] and got[1]["users"] == 20 and got[2]["failed"] == 0 and 27 <= got[1]["median"] <= 30


def test_weeks_count_users_exactly(spark, tmp_path):
    """Sketches of 6,000 users are some per cent off."""
    from foliospark.plans import states

    rows = spark.range(18_000).select(
        F.col("id").alias("event_id"), F.expr("timestamp_seconds(1704067200 + id % 14 * 86400)").alias("ts"), F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 6000).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
    )
    rows.write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for r in rows.collect():
        key = (r["ts"].day - 1) // 7, None if r["user_id"] is None else r["user_id"] % 3
        jobs, users = want.setdefault(key, [0, set()])
        want[key][0] = jobs + (2 if r["ts"].day == 10 else 1)
        users |= {r["user_id"]} - {None}
    got = {((r["week"].day - 1) // 7, r["model"]): [r["jobs"], r["users"]] for r in states.weekly_state(spark, str(tmp_path)).collect()}
    assert got == {k: [n, len(u)] for k, (n, u) in want.items()} and len(got) == 8


def test_ids_of_documents_are_not_sent_through_the_driver(spark, tmp_path):
    plans = []
    def joined(t):
        out = t["a"].join(t["b"], "document_id").select("document_id", F.lit(None).cast("string").alias("error"))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    good = lambda t: t["documents"].select("document_id", F.lit(None).cast("string").alias("error"))
    for n in (5, 9):
        Steps(spark, str(tmp_path)).add("a", good).add("b", good).add("c", joined, ["a", "b"]).run(spark.range(n).withColumnRenamed("id", "document_id"))
    assert len(plans) == 2 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert Steps(spark, str(tmp_path)).add("c", joined).results("c").count() == 9
