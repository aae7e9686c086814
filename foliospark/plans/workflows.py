"""Registered queries over documents, jobs, batches, sources, sinks and engines. Each has SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from foliospark.engines import registry
from foliospark.operators import access, catalog, eav, jobs, pages, reports
from foliospark.plans import inputs as I
from foliospark.plans.queries import _DOCS_SQL
from foliospark.plans.registry import query
from foliospark.sinks import export
from foliospark.sources import files, paged
from foliospark.sources.files import table
from foliospark.streaming import ingest


@query(f"WITH {_DOCS_SQL} SELECT * FROM docs")
def all_documents_sorted(spark, d):
    """Without a limit, by several keys."""
    return catalog.listed(I.documents(spark, d), sort=["status", "-upload_date", "uploaded_by"], limit=None)


@query(f"WITH {_DOCS_SQL} SELECT * FROM docs WHERE status = 'completed' ORDER BY uploaded_by, upload_date DESC, document_id LIMIT 40 OFFSET 20")
def list_by_several_keys(spark, d):
    return catalog.listed(I.documents(spark, d), status="completed", sort=["uploaded_by", "-upload_date"], skip=20, limit=40)


@query(f"WITH {_DOCS_SQL} SELECT document_id FROM docs WHERE upload_date BETWEEN '1995-01-01' AND '1995-12-31' AND status = 'failed' AND contains('title ' || document_id, '7')")
def search_by_title_date_and_type(spark, d):
    docs = I.documents(spark, d).withColumn("title", F.concat(F.lit("Title "), F.col("document_id"))).withColumn("tag", F.lit(None).cast("string"))
    found = catalog.searched(docs, "7", ("tag", "title"), since="1995-01-01", until="1995-12-31", kind="failed", kind_column="status")
    return found.select("document_id")


@query(f"WITH {_DOCS_SQL} SELECT * FROM docs")
def admin_documents(spark, d):
    """User 14 is an admin and sees everything."""
    return access.visible(I.documents(spark, d), I.user_roles(spark, d), 14)


@query("SELECT o_orderkey AS document_id, 'f' || o_orderkey AS path FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def missing_files(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("f"), F.col("o_orderkey")).alias("path"))
    return catalog.missing_files(docs, table(spark, d, "lineitem").where("l_linenumber = 4").select(F.concat(F.lit("f"), F.col("l_orderkey")).alias("path"))).select("document_id", "path")


@query("SELECT o_orderkey AS session_id FROM orders WHERE o_orderdate > TIMESTAMP '1997-06-01 00:00:00'")
def live_sessions(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("expires_at"))
    return access.live_sessions(s, "1997-06-01 00:00:00").select("session_id")


_STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END"


def _batch_events(spark, d):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    return table(spark, d, "events").select(F.col("user_id").alias("batch_id"), status.alias("status"), F.col("ts").alias("at"), "event_id")


@query(f"SELECT user_id AS batch_id, arg_max({_STATUS}, (ts, event_id)) AS status FROM events GROUP BY user_id")
def batch_status(spark, d):
    return jobs.batch_status(_batch_events(spark, d)).select("batch_id", "status")


@query(f"SELECT batch_id, 'cancelled' AS status FROM (SELECT user_id AS batch_id, arg_max({_STATUS}, (ts, event_id)) AS s FROM events GROUP BY user_id) WHERE s = 'processing' AND batch_id % 3 = 0")
def cancelled_batches(spark, d):
    """Of the batches asked for (every third), those that were active end as cancelled."""
    events = _batch_events(spark, d)
    asked = events.select("batch_id").where("batch_id % 3 = 0").distinct()
    more = jobs.cancelled(events, asked, F.lit("2099-01-01").cast("timestamp")).withColumn("event_id", F.lit(0).cast("long"))
    return jobs.batch_status(events.unionByName(more)).where("status = 'cancelled'").select("batch_id", "status")


@query("SELECT c_custkey AS document_id, 'uploaded' AS status FROM customer WHERE c_custkey % 5 <> 0")
def soft_delete(spark, d):
    """Deleted documents (every fifth) leave the list, not the table."""
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("uploaded").alias("status"))
    gone = jobs.soft_deleted(docs.where("document_id % 5 = 0"), F.lit("2024-01-01").cast("timestamp")).withColumn("event_id", F.lit(1))
    return jobs.current_status(docs, gone)


_JOBS = "SELECT user_id AS document_id, event_type, ts, event_id FROM events"


def _jobs(spark, d):
    kind = F.when(F.col("event_type") == "click", "llm_summary").when(F.col("event_type") == "purchase", "template").otherwise("ocr")
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), kind.alias("job_type"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("ts").alias("completed_at"))


@query("""SELECT 'document.created' AS event, c_custkey AS document_id, NULL::TIMESTAMP AS at FROM customer UNION ALL
  SELECT CASE event_type WHEN 'click' THEN 'llm.completed' WHEN 'purchase' THEN 'template.completed' ELSE 'ocr.completed' END, user_id, ts FROM events WHERE event_type <> 'error'""")
def document_events(spark, d):
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit(None).cast("timestamp").alias("created_at"))
    return jobs.document_events(docs, _jobs(spark, d))


@query("""SELECT CASE event_type WHEN 'click' THEN 'llm.completed' WHEN 'purchase' THEN 'template.completed' ELSE 'ocr.completed' END AS event, user_id AS document_id, ts AS at FROM events WHERE event_type <> 'error'""")
def stream_document_events(spark, d):
    """The events of jobs written by a stream."""
    made = ingest.stream_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "llm_summary").when(F.col("event_type") == "purchase", "template").otherwise("ocr")
    done = made.select(F.col("user_id").alias("document_id"), kind.alias("job_type"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("ts").alias("completed_at"))
    docs = done.where("false").select("document_id", F.col("completed_at").alias("created_at"))
    folder = ingest.scratch(spark)
    ingest.run_events(jobs.document_events(docs, done), f"{folder}/events", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/events").select("event", "document_id", "at")


@query("""SELECT event_type AS engine, count(*)::BIGINT AS jobs, count(*) FILTER (event_id % 3 <> 0)::BIGINT AS completed, count(*) FILTER (event_id % 3 = 0)::BIGINT AS failed, round(count(*) FILTER (event_id % 3 <> 0) / count(*) * 100, 6) AS success_rate FROM events GROUP BY 1""")
def engine_report(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("engine"), F.when(F.col("event_id") % 3 == 0, "failed").otherwise("completed").alias("status"))
    return reports.by_engine(e).withColumn("success_rate", F.round("success_rate", 6))


@query("""SELECT lang AS engine, count(*)::BIGINT AS rated, count(*) FILTER (quality = 1)::BIGINT AS correct, round(count(*) FILTER (quality = 1) / count(*) * 100, 6) AS accuracy FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1""")
def accuracy_report(spark, d):
    met = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("lang").alias("engine"), (F.col("quality") == 1).alias("correct"))
    return reports.accuracy(met).withColumn("accuracy", F.round("accuracy", 6))


@query("""SELECT model, calls, tokens, CASE WHEN model <> 'error' THEN round(tokens / 1000 * 0.5, 6) END AS cost FROM (SELECT event_type AS model, count(*)::BIGINT AS calls, sum(user_id + CASE WHEN event_id % 2 = 0 THEN event_id % 10 ELSE 0 END)::BIGINT AS tokens FROM events GROUP BY 1)""")
def usage_cost(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("prompt_tokens"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 10).alias("completion_tokens"))
    prices = table(spark, d, "events").select(F.col("event_type").alias("model"), F.lit(0.5).alias("price")).where("model <> 'error'").distinct()
    return reports.usage_cost(calls, prices).withColumn("cost", F.round("cost", 6))


@query("SELECT event_type AS model, sum(user_id + CASE WHEN event_id % 2 = 0 THEN event_id % 10 ELSE 0 END)::BIGINT AS tokens FROM events GROUP BY 1")
def token_sums(spark, d):
    calls = table(spark, d, "events").select(F.col("event_type").alias("model"), F.col("user_id").alias("prompt_tokens"), F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 10).alias("completion_tokens"))
    return registry.tokens_per_model(calls)


@query("SELECT user_id, count(*)::BIGINT AS actions, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT ts::DATE)::BIGINT AS days FROM events GROUP BY 1")
def user_activity(spark, d):
    return reports.user_activity(table(spark, d, "events").select("user_id", F.col("event_type").alias("action"), F.col("ts").alias("at")))


@query("SELECT ts::DATE AS day, count(*)::BIGINT AS jobs, round(avg(value), 6) AS mean_seconds, max(value) AS longest_seconds FROM events GROUP BY 1")
def daily_performance(spark, d):
    return reports.daily(table(spark, d, "events"), "ts", F.col("value")).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query("SELECT event_type, CASE WHEN value > 90 THEN 'value' ELSE '' END || CASE WHEN event_id % 2 = 1 THEN CASE WHEN value > 90 THEN ',even' ELSE 'even' END ELSE '' END AS broken, count(*)::BIGINT AS n FROM (SELECT DISTINCT event_type, event_id, value FROM events) GROUP BY ALL")
def broken_rules(spark, d):
    """Distinct rows by the rules that they break."""
    rows = table(spark, d, "events").select("event_type", "event_id", "value").dropDuplicates()
    found = jobs.valid_rows(rows, {"value": F.col("value") <= 90, "even": F.col("event_id") % 2 == 0})
    return found.groupBy("event_type", F.array_join("broken", ",").alias("broken")).agg(F.count("*").alias("n"))


@query("SELECT 25.0::DOUBLE AS remaining, 75.0::DOUBLE AS progress, o_orderkey FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 0.0, 0.0, o_orderkey FROM orders WHERE o_orderkey % 2 = 0")
def progress_cases(spark, d):
    """Time left and progress of batches of four, of which three or none are done after 75 seconds."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 1, 3).otherwise(0).alias("done"))
    return o.select("o_orderkey", jobs.remaining_seconds(F.lit(75.0), F.col("done"), F.lit(4)).alias("remaining"), jobs.percent(F.col("done"), F.lit(4)).alias("progress"))


@query("SELECT DISTINCT o_orderpriority || '-gpt-4' AS model FROM orders")
def model_lists(spark, d):
    """Models that are spoken to by turns, out of a list for each order."""
    made = table(spark, d, "orders").select(F.array(F.concat(F.col("o_orderpriority"), F.lit("-gpt-4")), F.lit("davinci"), F.lit(None).cast("string")).alias("models"))
    return made.select(F.explode(F.filter("models", registry.is_chat_model)).alias("model")).distinct()


@query("SELECT o_orderkey AS document_id, true AS success, 'order ' || o_orderkey AS reply, 2 AS prompt_tokens, 2 AS completion_tokens FROM orders")
def generate_replies(spark, d):
    """The stand-in engine over a prompt for each order."""
    prompts = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("order "), F.col("o_orderkey")).alias("prompt"))
    return registry.generated(prompts, "summary").select("document_id", "success", "reply", "prompt_tokens", "completion_tokens")


@query("""SELECT document_id, md5('--- 페이지 1 ---' || chr(10) || chr(10) || a || chr(10) || chr(10) || '--- 페이지 2 ---' || chr(10) || chr(10) || b) AS text_hash, b AS category FROM (SELECT o_orderkey AS document_id, o_orderpriority AS a, o_orderstatus AS b FROM orders)""")
def document_chain(spark, d):
    """Recognition and merging beside a model's reply, then both joined: steps applied one after another."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.lit("txt").alias("file_type"), F.concat("o_orderpriority", F.lit("\f"), "o_orderstatus").cast("binary").alias("content"), "o_orderstatus")
    replies = o.select(F.col("path").alias("document_id"), F.lit("classification").alias("task"), F.col("o_orderstatus").alias("reply"))
    steps = [
        lambda df: files.read_pages(df, registry.engine("pages")), pages.merge,
        lambda df: df.join(eav.shred_reply(replies).select("document_id", F.col("field_value").alias("category")), "document_id"),
        lambda df: df.select(F.col("document_id").cast("long").alias("document_id"), F.md5("text").alias("text_hash"), "category"),
    ]
    return reduce(lambda df, step: step(df), steps, o)


@query("SELECT 'txt' AS file_type, 'application/octet-stream' AS mime_type, length(c_name)::BIGINT + 1 AS file_size, sha256(c_name || chr(10)) AS sha256, 1 AS pages FROM customer")
def ingest_files(spark, d):
    """A file for each customer, written by the tasks, listed with metadata, stored by year and month, recognised page by page."""
    folder = ingest.scratch(spark)
    customers = table(spark, d, "customer")
    rows = customers.select(F.concat(F.monotonically_increasing_id(), F.lit(".txt")).alias("name"), F.concat(F.coalesce("c_name", F.lit("")), F.lit("\n")).cast("binary").alias("content"))
    files.write_files(rows, f"{folder}/in", -(-customers.count() // files.FOLDER_FILES) or 1).write.parquet(f"{folder}/folders")
    folders = spark.read.parquet(f"{folder}/folders").repartition(spark.sparkContext.defaultParallelism * 4)
    files.ingested(files.files_of(folders, ".txt"), f"{folder}/stored")
    stored = spark.read.parquet(f"{folder}/stored").where("year >= 2000 and month between 1 and 12 and stored_name is not null")
    read = files.read_pages(stored, registry.engine("pages")).groupBy(F.col("document_id").alias("path")).agg(F.count("*").cast("int").alias("pages"))
    return stored.join(read, "path").select("file_type", "mime_type", "file_size", "sha256", "pages")


@query("SELECT md5(translate(text, chr(12), ' ')) AS text_hash, count(*)::BIGINT AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def paged_files(spark, d):
    """Whole documents as pages of a few large files, read back by ranges of 64 KB; the pages' numbers go through each file without a gap."""
    folder = ingest.scratch(spark)
    docs = table(spark, d, "documents").where("text is not null").select(F.translate("text", "\f", " ").alias("text"))
    docs.write.option("lineSep", "\f").text(f"{folder}/in")
    paged.pages(spark, f"{folder}/in", suffix=".txt", range=65536).write.parquet(f"{folder}/pages")
    found = spark.read.parquet(f"{folder}/pages")
    whole = found.groupBy("path").agg(F.max("page_number").alias("last"), F.count_distinct("page_number").alias("pages")).where("last = pages").select("path")
    return found.join(whole, "path").groupBy(F.md5("text").alias("text_hash")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT -1, 'a,\"b\"'")
def csv_round_trip(spark, d):
    folder = ingest.scratch(spark)
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
    export.to_csv(n.union(spark.range(1).select(F.lit(-1), F.lit('a,"b"'))), f"{folder}/csv")
    return spark.read.option("header", True).option("escape", '"').option("lineSep", "\r\n").schema("n_nationkey int, n_name string").csv(f"{folder}/csv")


@query("SELECT n_nationkey::INT AS n_nationkey, n_name FROM nation")
def json_round_trip(spark, d):
    folder = ingest.scratch(spark)
    export.to_json(table(spark, d, "nation").select("n_nationkey", "n_name"), f"{folder}/json")
    return spark.read.schema("n_nationkey int, n_name string").json(f"{folder}/json")


@query("SELECT n_nationkey AS document_id, '2025-01-0' || k AS day FROM nation, (VALUES (1), (2)) v(k)")
def appended_days(spark, d):
    folder = ingest.scratch(spark)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("document_id"), F.lit("f").alias("field_name"), F.col("n_name").alias("field_value"))
    for day in ("2025-01-01", "2025-01-02"):
        export.append_rows(rows, f"{folder}/rows", day)
    return spark.read.parquet(f"{folder}/rows").select("document_id", F.col("day").cast("string").alias("day"))


@query("SELECT c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 'Ask {reader}' ELSE 'Sum up {text} for {reader}' END AS template, CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 2 END AS fields FROM customer WHERE c_custkey > 3")
def stored_templates(spark, d):
    """A template for each customer, some replaced, a few removed again, listed."""
    folder = ingest.scratch(spark)
    rows = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.lit("").alias("description"), F.lit("Sum up {text} for {reader}").alias("template"), "c_custkey")
    files.store_templates(rows, folder)
    files.store_templates(rows.where("c_custkey % 10 = 0").withColumn("template", F.lit("Ask {reader}")), folder)
    files.remove_templates(rows.where("c_custkey <= 3").select("name"), folder)
    return files.templates(spark, folder).select("name", "template", F.size("variables").alias("fields"))


@query("SELECT c_custkey AS document_id, '<Row><Cell><Data ss:Type=\"String\">name</Data></Cell><Cell><Data ss:Type=\"String\">' || c_name || '</Data></Cell></Row>' AS row FROM customer")
def export_spreadsheet(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("document_id"), F.lit("name").alias("field"), F.col("c_name").alias("value"))
    return export.spreadsheet(c).select("document_id", F.regexp_extract("workbook", "(<Row>.*</Row>)", 1).alias("row"))
