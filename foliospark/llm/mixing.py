"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sizes are whole numbers of words, so sums are exact and every run gives the same result whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import n_words, stored

#: Hexadecimal digits of a document's draw that make its slot; 16^SLOT_DIGITS slots of each source are summed apart.
SLOT_DIGITS = 3


def draw(doc_id: Column, text_hash: Column, seed: int) -> Column:
    """The document's place in the seeded order of its source: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), text_hash))


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with rank: 0 for the least by code point, null last.

    Ranks come from a range sort and the row counts of its partitions, so no task sees all sources.
    """
    placed = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id())
    placed = stored(placed.select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__row")), "ranks")
    counts = placed.groupBy("__part").count().orderBy("__part").collect()  # a row for each partition of the sort
    ahead, before = 0, {}
    for part, n in counts:
        before[part], ahead = ahead, ahead + n
    start = F.coalesce(*[F.when(F.col("__part") == p, F.lit(n)) for p, n in before.items()], F.lit(0)) if before else F.lit(0)
    return placed.withColumn("rank", (F.col("__row") + start).cast("long")).drop("__at", "__part", "__row")


def water_filled(sources: DataFrame, budget_share: float, max_epochs: float) -> DataFrame:
    """sources (source, source_size, weight) with target double.

    The budget (budget_share of all sizes) goes to the sources by weight; what would lift one above max_epochs times its
    size stops there, and its excess goes to the others by weight until none is above. The level (words a unit of
    weight) only rises, so it takes as many rounds as caps are met at different levels; each is one aggregate. Where
    the caps together can't hold the budget every source ends at its cap. Weights are positive.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = cap <= F.col("weight") * F.lit(level)
        held, free = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        raised = (budget_share * total - (held or 0.0)) / free if free else float("inf")
        if not free or raised <= level:
            break
        level = raised
    share = cap if level == float("inf") or not free else F.least(cap, F.col("weight") * F.lit(level))
    return sources.withColumn("target", share.cast("double"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), budget_share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, whole: bool = False) -> DataFrame:
    """docs (doc_id, text, source) to doc_id, size, source, source_size, target, repeats, taken; one row per input row.

    Every document is taken floor(target / source_size) times whole. The rest of the target goes to the documents of
    the source in seeded order: one more whole repetition each until the next would pass the target; that one gives its
    first words up to the target (whole=False), or all or nothing, whichever is nearer (whole=True). repeats counts
    whole repetitions and taken words. Null texts have size 0; a null source is a source of its own and the last.
    Repeated rows count each time, of equal rows any may be the partial one; a null doc_id is drawn like an empty one;
    a text's length is no matter; other columns are left out; an empty table gives an empty one. No document exceeds ceil(max_epochs) repetitions.
    """
    text_hash = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    sized = stored(docs.select("doc_id", "source", n_words("text").alias("size"), draw(F.col("doc_id"), text_hash, seed).alias("draw")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    targets = water_filled(stored(ranked_sources(sources).withColumn("weight", cycle), "weights"), budget_share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    slots = sized.withColumn("slot", F.substring("draw", 1, SLOT_DIGITS)).groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    slots = slots.withColumn("ahead", F.expr("sum(slot_size) over (partition by source order by slot) - slot_size"))
    plan = stored(slots.join(targets, slots.source.eqNullSafe(targets.source)).drop(targets.source), "plan")
    placed = sized.withColumn("slot", F.substring("draw", 1, SLOT_DIGITS))
    placed = placed.join(plan, placed.source.eqNullSafe(plan.source) & (placed.slot == plan.slot)).drop(plan.source).drop(plan.slot)
    within = F.expr("sum(size) over (partition by source, slot order by draw rows between unbounded preceding and current row) - size")
    placed = placed.withColumn("left", F.col("rest") - F.col("ahead") - within)
    piece = F.greatest(F.lit(0), F.least("size", "left"))
    more = F.when(piece * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else piece
    taken = (F.col("epochs") * F.col("size") + more).cast("long")
    repeats = F.col("epochs") + F.when((more == F.col("size")) & (F.col("left") > 0), 1).otherwise(0)
    return placed.select("doc_id", "source", "size", "source_size", "target", repeats.cast("int").alias("repeats"), taken.alias("taken"), "draw")


def mixed_documents(docs: DataFrame, seed: int = 17, **options) -> DataFrame:
    """docs as the mix takes them: every row comes as often as it is repeated, whole, or not at all.

    All columns are kept, whatever their names. Equal rows are repeated rows of their own; null texts count as empty
    and are taken with the whole repetitions of their source; an empty table gives an empty one.
    """
    plan = mix(docs, seed=seed, whole=True, **options).select(F.col("draw").alias("plan_draw"), F.col("source").alias("plan_source"), "repeats")
    plan = plan.withColumn("nth", F.expr("row_number() over (partition by plan_draw, plan_source order by repeats)"))
    own = draw(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")), seed)
    keyed = docs.select(F.struct("*").alias("row"), own.alias("own_draw"), F.col("source").alias("own_source"), F.col("doc_id").alias("own_id"))
    keyed = keyed.withColumn("same", F.expr("row_number() over (partition by own_draw, own_source order by own_id)"))
    met = keyed.join(plan, (F.col("own_draw") == F.col("plan_draw")) & F.col("own_source").eqNullSafe(F.col("plan_source")) & (F.col("same") == F.col("nth")))
    return met.where("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("copy")).select("row.*")


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


#: Caps are met in order of cap / weight; the level is the first that the caps not yet met allow.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS weight FROM sources),
tried AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS held,
         sum(weight) OVER (ORDER BY source_size / weight DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS free,
         sum(source_size) OVER () AS total
  FROM weighed WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (
  SELECT *, (SELECT arg_min((1.5::DOUBLE * t.total - t.held) / t.free, t.held) FROM tried t
             WHERE 2.0 * t.source_size / t.weight > (1.5::DOUBLE * t.total - t.held) / t.free) AS level FROM tried),
targets AS (
  SELECT source, source_size, coalesce(least(2.0::DOUBLE * source_size, weight * level), 2.0::DOUBLE * source_size) AS target FROM leveled),
whole AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
placed AS (
  SELECT s.*, w.source_size, w.target, w.epochs,
         round(w.target - w.epochs * w.source_size)::BIGINT
           - (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS remains
  FROM sized s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, remains)))::BIGINT AS taken,
       (epochs + CASE WHEN greatest(0, least(size, remains)) = size AND remains > 0 THEN 1 ELSE 0 END)::INT AS repeats
FROM placed
"""
