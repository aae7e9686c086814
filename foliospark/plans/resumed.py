"""Registered query over steps that are run again. It has SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.plans.registry import query
from foliospark.plans.steps import Steps
from foliospark.sources.files import table
from foliospark.streaming.ingest import scratch


@query("""WITH r AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS fresh, o_orderkey % 7 = 0 AS unread, o_orderkey % 11 = 0 AS broken FROM orders)
  SELECT document_id, 'read' AS step, CASE WHEN broken THEN 'failed' ELSE 'done' END AS state, CASE WHEN broken AND fresh = 0 THEN 2 WHEN unread AND fresh = 0 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN broken OR unread THEN 1 ELSE fresh END::INT AS run FROM r
  UNION ALL SELECT document_id, 'classify', 'done', 1, fresh FROM r
  UNION ALL SELECT document_id, 'join', 'done', 1, CASE WHEN unread THEN 1 ELSE fresh END FROM r WHERE NOT broken""")
def resumed_steps(spark, d):
    """Reading and classifying side by side, then joining. In the first run a seventh can't be read; the second does those and the tenth that is new, and fails again where it always does."""
    folder = scratch(spark)
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), "o_orderpriority", "o_orderstatus")

    def steps(first: bool) -> Steps:
        fails = (F.col("document_id") % 11 == 0) | (F.lit(first) & (F.col("document_id") % 7 == 0))
        return (
            Steps(spark, folder)
            .add("read", lambda t: t["documents"].select("document_id", F.col("o_orderpriority").alias("text"), F.when(fails, "unreadable").alias("error")))
            .add("classify", lambda t: t["documents"].select("document_id", F.col("o_orderstatus").alias("category"), F.lit(None).cast("string").alias("error")))
            .add("join", lambda t: t["read"].join(t["classify"], "document_id").select("document_id", F.concat_ws(" ", "text", "category").alias("result"), F.lit(None).cast("string").alias("error")), ["read", "classify"])
        )

    steps(True).run(docs.where("document_id % 10 <> 0"))
    second = steps(False)
    second.run(docs)
    return second.manifest()
