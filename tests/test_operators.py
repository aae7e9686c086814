"""Operators, sinks, sources and streams on small inputs, and every registered query against its SQL."""

import csv
import glob
import json

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.engines import registry
from foliospark.functions import extract
from foliospark.operators import catalog, eav, jobs, pages, prompts
from foliospark.plans import fields, named, qualities, queries, resumed, searches, states, streams, templates, timelines, workflows  # noqa: F401  they register their queries
from foliospark.plans import registry as plans
from foliospark.sinks import export
from foliospark.sources import files
from foliospark.streaming import ingest

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query(spark, con, name):
    want = con.execute(plans.SQL[name]).fetchall()
    names = [c[0] for c in con.description]
    df = plans.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    key = lambda r: tuple(map(str, r))
    assert sorted((plain(tuple(r[n] for n in names)) for r in df.collect()), key=key) == sorted(map(plain, want), key=key)


EAV = "document_id long, field_name string, field_value string"


def test_structure_and_maps(spark):
    rows = [(1, "full_text", "t"), (1, "summary", ""), (1, "dates_1", "d"), (1, "personal_info_name", "n"), (1, "plain", "p"), (1, "dates_1", "e"), (2, "a", "x"), (2, "a_b", "y"), (2, "c_d", " ")]
    out = eav.structure(spark.createDataFrame(rows, EAV))
    got = {(r[0], r[1], r[2]): r[3] for r in out.collect()}
    assert got == {(1, None, "full_text"): "t", (1, "dates", "1"): "e", (1, "personal", "info_name"): "n", (1, None, "plain"): "p", (2, None, "a"): "x", (2, "a", "b"): "y", (2, "c", "d"): " "}
    assert [tuple(r) for r in eav.clashes(out).collect()] == [(2, "a")]
    assert eav.pruned(out).where("group_name = 'c'").count() == 0
    maps = {r["document_id"]: r for r in eav.as_maps(out).collect()}
    assert maps[1]["groups"] == {"dates": {"1": "e"}, "personal": {"info_name": "n"}} and maps[1]["singles"] == {"full_text": "t", "plain": "p"}


def test_values_are_normalised_once(spark):
    """No filter repeats the normalisation, and what normalises to nothing goes all the same."""
    rows = [(1, "contact_phone", "none"), (1, "contact_fax", " 1 "), (1, "a_date", "2024.1.2"), (1, "b_c", "  "), (1, "plain", None)]
    out = eav.processed(spark.createDataFrame(rows, EAV))
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    filters = [x for x in plan if x.lstrip(" :+-").startswith("Filter")]
    assert filters and not any("lower(" in x for x in filters) and not any("_by(" in x for x in plan)
    assert sorted(map(tuple, out.collect())) == [(1, "a", "date", "2024-01-02"), (1, "contact", "fax", "1")]


def test_structure_takes_first_and_last(spark):
    rows = [(1, "summary", "b", 2), (1, "summary", "z", 1), (1, "a_b", "y", 1), (1, "a_b", "x", 2), (2, "summary", None, 1), (2, "summary", "x", 2), (2, "c_d", None, 1), (2, "c_d", "w", 1), (2, "e_f", None, None), (2, "a_summary", "k", 1), (2, "a_summary", "m", 1)]
    df = spark.createDataFrame(rows, EAV + ", n int")
    by_order = {tuple(r) for r in eav.structure(df, "n").collect()}
    assert by_order == {(1, None, "summary", "z"), (1, "a", "b", "x"), (2, "c", "d", "w"), (2, "e", "f", None), (2, "a", "summary", "m")}
    by_value = {tuple(r) for r in eav.structure(df).collect()}
    assert by_value == {(1, None, "summary", "b"), (1, "a", "b", "y"), (2, "c", "d", "w"), (2, "e", "f", None), (2, "a", "summary", "m")}


def test_shred_and_reassemble(spark):
    docs = spark.createDataFrame([(1, "이름: 홍길동 a@b.co c@d.org 100원 2025-01-02", 0.5)], "document_id long, text string, confidence double")
    rows = eav.shred(docs.withColumn("entities", extract.structured(F.col("text"), False)))
    names = {r["field_name"]: r["field_value"] for r in rows.collect()}
    assert names["personal_info_emails_2"] == "c@d.org" and names["personal_info_name"] == "홍길동" and names["dates_1"] == "2025년 01월 02일" and names["amounts_1_currency"] == "KRW"
    back = {(r["category"], r["field"], r["item"]): r["value"] for r in eav.reassemble(rows).collect()}
    assert back["personal_info", "emails", 1] == "a@b.co" and back["amounts", "currency", 1] == "KRW" and back["dates", None, 1] == "2025년 01월 02일"


def test_amounts_keep_their_numbers(spark):
    text = "12,300원 그리고 00012345678901234567890원 그리고 $1,234.5 $ 25000000 $0.00002 $123456789012345678"
    docs = spark.createDataFrame([(1, text, 0.5)], "document_id long, text string, confidence double")
    rows = eav.shred(docs.withColumn("entities", extract.structured(F.col("text"), False)))
    names = {r["field_name"]: r["field_value"] for r in rows.collect()}
    want = [str(12300), str(12345678901234567890), str(1234.5), str(25000000.0), str(0.00002), str(123456789012345678.0)]
    assert [names[f"amounts_{i}_value"] for i in range(1, 7)] == want
    back = {(r["category"], r["field"], r["item"]): r["value"] for r in eav.reassemble(rows).collect()}
    assert back["amounts", "value", 3] == "1234.5"


def test_result_view_keeps_all_members(spark):
    jobs_ = [(1, "llm_summary", "completed", 1, 2, 10, "old", None), (1, "llm_summary", "failed", 3, None, 11, None, "broke"), (1, "ocr", "completed", 4, 5, 12, "x", None)]
    df = spark.createDataFrame(jobs_, "document_id long, job_type string, status string, created_at long, completed_at long, job_id long, result string, error_message string")
    results = eav.result_view(df).first()["results"]
    assert {k: v.asDict() for k, v in results.items()} == {"summary": {"job_id": 11, "status": "failed", "created_at": 3, "completed_at": None, "result": None, "error_message": "broke"}}


def test_replies(spark):
    rows = [(1, "summary", "s"), (2, "classification", " c "), (3, "extraction", '{"a": 1, "b": "x", "c": [1]}'), (4, "qa", "q")]
    got = {(r[0], r[1], r[2]) for r in eav.shred_reply(spark.createDataFrame(rows, "document_id long, task string, reply string")).collect()}
    assert got == {(1, "summary", "s"), (2, "category", "c"), (3, "a", "1"), (3, "b", "x")}


def test_bad_arguments(spark):
    df = spark.createDataFrame([], EAV)
    for call in (lambda: eav.mapped(df, {}, "x"), lambda: catalog.listed(df, status="odd"),
                 lambda: prompts.rendered("{a}", {}), lambda: registry.engine("none"), lambda: registry.generated(df, "none")):
        with pytest.raises(ValueError):
            call()


def test_progress(spark):
    df = spark.createDataFrame([(1, i, i, i != 1) for i in range(2)], "batch_id int, document_id int, completed_at int, success boolean")
    got = jobs.batch_totals(df, F.lit(3)).first()
    assert (got["total"], got["processed"], got["failed"], round(got["progress"], 2), got["success_rate"]) == (3, 2, 1, 66.67, 50.0)
    assert [tuple(r) for r in jobs.running_progress(df).orderBy("processed").collect()] == [(1, 0, 1, 0), (1, 1, 2, 1)]
    assert jobs.tail(df, ["completed_at"], 0).count() == 0
    assert df.limit(1).select(jobs.remaining_seconds(F.lit(10.0), F.lit(2), F.lit(6)), jobs.percent(F.lit(0), F.lit(0), 100.0)).first()[:] == (20.0, 100.0)


def test_boxes(spark):
    df = spark.createDataFrame([([("a", 90.0), (" ", 50.0), ("b", -1.0)],)], "boxes array<struct<text:string,conf:double>>")
    row = df.select(pages.word_confidence(F.col("boxes")), F.size(pages.real_boxes(F.col("boxes")))).first()
    assert row[:] == (0.7, 1)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "date", "2025-06-01"), (1, "amount", '100,000 "원"<b>')], "document_id int, field string, value string")
    export.to_csv(rows.select("field", "value").coalesce(1), str(tmp_path / "csv"))
    raw = open(glob.glob(str(tmp_path / "csv/*.csv"))[0], newline="").read()
    assert "\r\n" in raw and list(csv.reader(raw.splitlines())) == [["field", "value"], ["date", "2025-06-01"], ["amount", '100,000 "원"<b>']]
    assert json.loads(export.json_array(rows).first()["json"])[0] == {"field": "amount", "value": '100,000 "원"<b>'}
    assert "&lt;b&gt;" in export.html_table(rows).first()["html"] and "&quot;" in export.spreadsheet(rows).first()["workbook"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"bad")
    (tmp_path / "t.json").write_text('{"name": "t", "template": "{x}", "variables": ["x"]}')
    (tmp_path / "u.json").write_text("not json")
    found = files.binary_files(spark, str(tmp_path), "*.[Ptt]*")
    assert {(r["filename"], r["mime_type"]) for r in found.collect()} >= {("a.PDF", "application/pdf"), ("b.txt", "application/octet-stream")}

    def engine(content, kind):
        if kind != "pdf":
            raise ValueError("no pages")
        return [(t.decode(), 0.5) for t in content.split(b"\f")]

    read = files.read_pages(found.where("filename in ('a.PDF', 'b.txt')"), engine)
    assert {(r["page_number"], r["text"], r["error"]) for r in read.collect()} == {(1, "one", None), (2, "two", None), (0, None, "no pages")}
    assert [r["name"] for r in files.templates(spark, str(tmp_path)).collect()] == ["t"]


def test_generation_isolates_failures(spark):
    @registry.register("odd")
    def odd(prompt, temperature, most):
        if "bad" in prompt:
            raise RuntimeError("refused")
        return prompt.upper()

    df = spark.createDataFrame([(1, "good one"), (2, "bad")], "document_id int, prompt string")
    got = {r["document_id"]: r for r in registry.generated(df, "summary", "odd").collect()}
    assert got[1]["reply"] == "GOOD ONE" and not got[2]["success"] and got[2]["error"] == "refused"
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert registry.retried(flaky, first_wait=0)() == "ok"


def test_streams(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.where("event_id % 2 = 0").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    keys, order = ["user_id", "event_type"], ["ts", "event_id"]
    ingest.run_upsert(stream, target, str(tmp_path / "cp"), keys, order)
    events.where("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(str(source))
    ingest.run_upsert(stream, target, str(tmp_path / "cp"), keys, order)
    ingest.run_upsert(stream, target, str(tmp_path / "cp"), keys, order)  # nothing new
    want = jobs.latest(events, keys, order)
    assert ingest.current(spark, target, keys, order, events.schema).count() == want.count()
    got = ingest.current(spark, target, keys, order, events.schema).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_lookups_settings_and_append(spark, tmp_path):
    df = spark.createDataFrame([({"a": {"b": "x"}}, '{"r": [{"x": 1}]}')], "g map<string,map<string,string>>, j string")
    row = df.select(eav.looked_up(F.col("g"), "a.b"), eav.looked_up(F.col("g"), "z.b"), eav.at_path(F.col("j"), "r[0].x")).first()
    assert row[:] == ("x", None, "1")
    (tmp_path / "s.json").write_text('{"a": {"x": 1}, "c": 3}')
    assert files.settings(spark, str(tmp_path / "s.json"), {"a": {"x": 0, "y": 2}, "b": 5}) == {"a": {"x": 1, "y": 2}, "b": 5, "c": 3}
    rows = spark.createDataFrame([(1, "a", "b")], EAV)
    for day in ("2025-01-01", "2025-01-02"):
        export.append_rows(rows, str(tmp_path / "eav"), day)
    assert spark.read.parquet(str(tmp_path / "eav")).count() == 2


def test_shredded_texts_that_hold_dates_and_amounts(spark, tmp_path):
    """Texts that the test tables lack give the rows of the SQL, too."""
    texts = ["on 2024-01-05 it cost $12.50", "이름: 홍길동 주소: 서울시 중구 세종로 12 금액 1,000 원 2024년 1월 5일", "call 010-1234-5678 or 0212345678, a@b.cc", "a@b.c.dd@e.ff .x@y.zz\r\n\0 1/2", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(plans.SQL["eav_shred"]).fetchall()
    assert sorted(tuple(r) for r in plans.QUERIES["eav_shred"](spark, str(tmp_path)).collect()) == sorted(want)
