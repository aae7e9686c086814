"""Registered queries over rules across rows and over duplicates. Each has SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import quality
from foliospark.plans.registry import query
from foliospark.sources.files import table

_L = "(SELECT *, l_orderkey || '-' || l_linenumber AS row_id FROM lineitem)"


@query(f"""SELECT 'unique l_orderkey, l_linenumber' AS rule, row_id FROM {_L} QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1
  UNION ALL SELECT 'l_orderkey gives l_returnflag', row_id FROM {_L} QUALIFY min(l_returnflag) OVER (PARTITION BY l_orderkey) <> max(l_returnflag) OVER (PARTITION BY l_orderkey)
  UNION ALL SELECT 'l_orderkey refers', row_id FROM {_L} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')""")
def rules_across_rows(spark, d):
    """Lines that come twice, orders whose lines have several flags, and lines whose order isn't among the open ones."""
    lines = table(spark, d, "lineitem").withColumn("row_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    open_ = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    found = quality.not_unique(lines, "row_id", ["l_orderkey", "l_linenumber"]).union(quality.not_dependent(lines, "row_id", ["l_orderkey"], "l_returnflag"))
    return found.union(quality.not_referring(lines, "row_id", "l_orderkey", open_, "o_orderkey")).select("rule", "row_id")


@query("""SELECT k AS row_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE k END AS root FROM (SELECT c_custkey, c_custkey AS k FROM customer UNION ALL SELECT c_custkey, c_custkey + 1000000 FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT c_custkey, c_custkey + 2000000 FROM customer WHERE c_custkey % 4 = 0)""")
def alike_customers(spark, d):
    """Customers of whom a fourth are there three times, with a letter changed near the beginning and another near the end: found by two orders, joined up over the one between."""
    c = table(spark, d, "customer")
    name = F.concat(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 20), F.lit(" "), F.col("c_mktsegment"))
    first, second = F.concat(F.substring(name, 1, 3), F.lit("x"), F.substring(name, 5, 99)), F.concat(F.substring(name, 1, 3), F.lit("x"), F.substring(name, 5, 13), F.lit("y"), F.substring(name, 19, 99))
    copies = F.array(F.struct(F.lit(0).alias("more"), name.alias("name")), F.struct(F.lit(1_000_000).alias("more"), first.alias("name")), F.struct(F.lit(2_000_000).alias("more"), second.alias("name")))
    rows = c.select("c_custkey", F.explode(copies).alias("r")).where("r.more = 0 or c_custkey % 4 = 0").select((F.col("c_custkey") + F.col("r.more")).alias("row_id"), "r.name")
    pairs = quality.alike_pairs(rows, "row_id", [F.col("name"), F.reverse("name")], lambda a, b: quality.likeness(a("name"), b("name")), 0.95)
    roots = quality.grouped(pairs)
    return rows.join(roots, rows.row_id == roots.node, "left").select("row_id", F.coalesce("root", "row_id").alias("root"))
