"""Entity-attribute-value rows: shredding, structuring, pruning, mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import normalize
from foliospark.functions.text import strip

#: Fields that stand alone although a group may bear their name.
SINGLE = ("full_text", "summary", "category")
#: Categories of extracted entities whose own names hold an underscore.
CATEGORIES = ("personal_info", "dates", "amounts", "tables")


def _float_text(value: Column) -> Column:
    """A double as Python writes it: plain from 1e-4 to under 1e16, else with an exponent of two digits or more."""
    text = value.cast("string")
    power = F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int")
    plain = F.regexp_replace(F.regexp_replace(text.try_cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", ".0")
    head = F.regexp_replace(F.regexp_extract(text, "^([^E]+)E", 1), r"\.0$", "")
    raised = F.concat(head, F.when(power < 0, "e-").otherwise("e+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    return F.when(power.isNull(), text).when(power.between(-4, 15), plain).otherwise(raised)


def _amount_text(amount: Column) -> Column:
    """The number of an amount as text: won as whole numbers of any length, other currencies as floats."""
    whole = F.replace(F.regexp_extract(amount["text"], r"^([\d,]+)", 1), F.lit(",")).try_cast("decimal(38,0)").cast("string")
    return F.when(amount["currency"] == "KRW", F.coalesce(whole, amount["value"].try_cast("decimal(38,0)").cast("string"))).otherwise(_float_text(amount["value"]))


def shred(documents: DataFrame) -> DataFrame:
    """(document_id, text, confidence, entities as extract.structured gives them) to EAV rows, list items numbered from 1."""
    e = F.col("entities")

    def one(name: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(name).alias("field_name"), value.alias("field_value")))

    def many(name: str, values: Column) -> Column:
        return F.coalesce(F.transform(values, lambda v, i: F.struct(F.concat(F.lit(f"{name}_"), i + 1).alias("field_name"), v.alias("field_value"))), F.array())

    won = F.coalesce(F.flatten(F.transform(e["amounts"], lambda a, i: F.array(
        F.struct(F.concat(F.lit("amounts_"), i + 1, F.lit("_value")).alias("field_name"), _amount_text(a).alias("field_value")),
        F.struct(F.concat(F.lit("amounts_"), i + 1, F.lit("_currency")).alias("field_name"), a["currency"].alias("field_value")),
        F.struct(F.concat(F.lit("amounts_"), i + 1, F.lit("_text")).alias("field_name"), a["text"].alias("field_value")),
    ))), F.array())
    rows = F.concat(
        one("full_text", F.col("text")), one("personal_info_name", e["name"]), one("personal_info_address", e["address"]),
        many("personal_info_phones", e["phones"]), many("personal_info_emails", e["emails"]), many("dates", e["dates"]), won,
    )
    return documents.select("document_id", "confidence", F.explode(rows).alias("r")).select("document_id", "r.*", "confidence", F.lit("ocr").alias("extraction_method")).where("field_value is not null")


def shred_reply(replies: DataFrame) -> DataFrame:
    """(document_id, task, reply) of a language model to EAV rows: a summary, a category, or one row per scalar member of an extraction's JSON; questions give none."""
    members = F.from_json(F.when(F.col("task") == "extraction", F.col("reply")), "map<string,string>")
    rows = (
        F.when(F.col("task") == "summary", F.array(F.struct(F.lit("summary").alias("field_name"), F.col("reply").alias("field_value"))))
        .when(F.col("task") == "classification", F.array(F.struct(F.lit("category").alias("field_name"), F.trim("reply").alias("field_value"))))
        .when(F.col("task") == "extraction", F.transform(F.filter(F.map_entries(members), lambda m: ~m["value"].rlike(r"^[\[{]")), lambda m: F.struct(m["key"].alias("field_name"), m["value"].alias("field_value"))))
    )
    return replies.select("document_id", F.explode(rows).alias("r")).select("document_id", "r.*", F.lit(0.0).alias("confidence"), F.lit("llm").alias("extraction_method"))


def structure(eav: DataFrame, order: str | None = None) -> DataFrame:
    """EAV rows to (document_id, group_name, field, value): names split at the first underscore, one value for each.

    group_name is null for single fields. Of several rows of one name the last by order stays (the first for single
    fields), by value where order is missing or equal; blank single fields are left out.
    """
    single = F.col("field_name").isin(*SINGLE) | ~F.col("field_name").contains("_")
    key = F.struct(*([F.col(order)] if order else []), F.col("field_value"))
    named = eav.select(
        "document_id",
        F.when(~single, F.substring_index("field_name", "_", 1)).alias("group_name"),
        F.when(single, F.col("field_name")).otherwise(F.expr("substr(field_name, instr(field_name, '_') + 1)")).alias("field"),
        key.alias("k"),
    )
    # the key holds the value, and each row goes into one of the two: a value is sorted and moved once
    first = F.col("group_name").isNull() & F.col("field").isin(*SINGLE)
    best = named.groupBy("document_id", "group_name", "field").agg(F.min(F.when(first, F.col("k"))).alias("low"), F.max(F.when(~first, F.col("k"))).alias("high"))
    out = best.select("document_id", "group_name", "field", F.coalesce("low", "high")["field_value"].alias("value"))
    return out.where(~first | (F.coalesce("value", F.lit("")) != ""))


def first_values(eav: DataFrame, order: str) -> DataFrame:
    """(document_id, field_name, field_value): of several rows of one name the first by order, of equal ones the least value."""
    return eav.groupBy("document_id", "field_name").agg(F.min_by("field_value", F.struct(order, "field_value")).alias("field_value"))


def displayed(eav: DataFrame, hidden: tuple = ("full_text",)) -> DataFrame:
    """Rows of the fields that are shown."""
    return eav.where(~F.col("field_name").isin(*hidden))


def confident(eav: DataFrame, least: float) -> DataFrame:
    return eav.where(F.col("confidence") >= least)


def field_names(structured: DataFrame) -> DataFrame:
    """(document_id, fields): names of the top level, each once, in order."""
    return structured.groupBy("document_id").agg(F.array_sort(F.collect_set(F.coalesce("group_name", "field"))).alias("fields"))


def scalar_members(rows: DataFrame, column: str) -> DataFrame:
    """rows with (name, value) for each member of a JSON object that is a text, a number or a truth value; texts that hold none give no row."""
    parsed = rows.withColumn("__json", F.try_parse_json(column)).where(F.schema_of_variant("__json").startswith("OBJECT"))
    met = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("__json").outer()))
    kind = F.schema_of_variant("value")
    met = met.where(~kind.rlike("^(OBJECT|ARRAY|VOID)"))
    return met.select(*rows.columns, F.col("key").alias("name"), F.col("value").cast("string").alias("value"))


def normalized(structured: DataFrame) -> DataFrame:
    """Values normalised by the name of the inner field, each once: a filter on them isn't pushed beneath a generator."""
    return normalize.normalized_values(structured, "field", "value").withColumn("value", F.explode(F.array("value")))


def processed(eav: DataFrame, order: str | None = None) -> DataFrame:
    """The whole way: structure, normalise, leave out what is blank."""
    return pruned(normalized(structure(eav, order)))


#: What a document without data says.
NO_DATA = "추출된 데이터가 없습니다."


def read_view(documents: DataFrame, eav: DataFrame) -> DataFrame:
    """documents with their data as maps (groups, singles), not normalised, or the message that there is none."""
    met = documents.join(as_maps(structure(eav)), "document_id", "left")
    return met.withColumn("message", F.when(F.col("groups").isNull() & F.col("singles").isNull(), NO_DATA))


def pruned(structured: DataFrame) -> DataFrame:
    """Without null and blank values; a group that loses all of them goes with them."""
    return structured.where(F.coalesce(strip(F.col("value")), F.lit("")) != "")


def clashes(structured: DataFrame) -> DataFrame:
    """(document_id, name) of names that are a single field and a group in one document."""
    groups = structured.where("group_name is not null").select("document_id", F.col("group_name").alias("name")).distinct()
    singles = structured.where("group_name is null").select("document_id", F.col("field").alias("name"))
    return singles.join(groups, ["document_id", "name"], "left_semi")


def as_maps(structured: DataFrame) -> DataFrame:
    """One row per document: groups as a map of maps, single fields as a map."""
    inner = structured.groupBy("document_id", "group_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
    return inner.groupBy("document_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("group_name").isNotNull(), F.struct("group_name", "fields"))), lambda a, b: F.when(a["group_name"] < b["group_name"], -1).otherwise(1))).alias("groups"),
        F.max_by("fields", F.when(F.col("group_name").isNull(), 1)).alias("singles"),
    )


def reassemble(eav: DataFrame) -> DataFrame:
    """EAV names back to (document_id, category, field, item, value): known categories, an item number at the second or last place."""
    pattern = f"^({'|'.join(CATEGORIES)})_(.+)$"
    rest = F.regexp_extract("field_name", pattern, 2)
    first, last = F.substring_index(rest, "_", 1).try_cast("int"), F.substring_index(rest, "_", -1).try_cast("int")
    field = F.when(first.isNotNull(), F.nullif(F.regexp_replace(rest, r"^\d+_?", ""), F.lit(""))).when(last.isNotNull(), F.regexp_replace(rest, r"_\d+$", "")).otherwise(rest)
    known = eav.where(F.col("field_name").rlike(pattern))
    return known.select("document_id", F.regexp_extract("field_name", pattern, 1).alias("category"), field.alias("field"), F.coalesce(first, last).alias("item"), F.col("field_value").alias("value"))


def mapped(eav: DataFrame, schemas: dict, schema: str) -> DataFrame:
    """One row per document in a target schema.

    schemas: {schema: {target: "group.field" or {"transform": "concat" | "first_non_empty", "fields": [...]}}}. concat
    joins what isn't null with blanks, first_non_empty takes the first that isn't null; another transform gives null.
    Unknown schemas raise before anything runs. Every document of eav has a row, with nulls where it lacks the fields;
    only the fields that the schema names are pivoted.
    """
    if schema not in schemas:
        raise ValueError(f"unknown schema {schema!r}; there are {sorted(schemas)}")
    rules = {t: {"transform": "first_non_empty", "fields": [r]} if isinstance(r, str) else r for t, r in schemas[schema].items()}
    paths = sorted({f for r in rules.values() for f in r["fields"]})
    path = F.concat_ws(".", "group_name", "field")
    wide = structure(eav).groupBy("document_id").agg(*[F.max(F.when(path == p, F.col("value"))).alias(p) for p in paths])
    column = {p: F.col(f"`{p}`") for p in paths}

    def target(rule: dict) -> Column:
        fields = [column[f] for f in rule["fields"]]
        if rule["transform"] == "concat":
            return F.nullif(F.concat_ws(" ", *fields), F.lit(""))
        return F.coalesce(*fields) if rule["transform"] == "first_non_empty" else F.lit(None).cast("string")

    return wide.select("document_id", *[target(r).alias(t) for t, r in rules.items()])


def merged(ocr: DataFrame, llm: DataFrame) -> DataFrame:
    """Two EAV tables as one: a model's value stands before the recognised one; each (document, field) comes once."""
    left = ocr.groupBy("document_id", "field_name").agg(F.max("field_value").alias("ocr"))
    right = llm.groupBy("document_id", "field_name").agg(F.max("field_value").alias("llm"))
    both = left.join(right, ["document_id", "field_name"], "full")
    return both.select("document_id", "field_name", F.coalesce("llm", "ocr").alias("field_value"), F.when(F.col("llm").isNotNull(), "llm").otherwise("ocr").alias("extraction_method"))


def by_template(documents: DataFrame, rules: list[dict]) -> DataFrame:
    """(document_id, text) to EAV rows by rules: {"name", "regex"} takes the first match, {"name", "keywords", "value"} a value after a keyword."""
    rows = []
    for rule in rules:
        pattern = rule.get("regex") or rf"(?:{'|'.join(rule['keywords'])})\s*[:：]?\s*({rule['value']})"
        group = 0 if rule.get("regex") else 1
        rows.append(F.struct(F.lit(rule["name"]).alias("field_name"), F.nullif(F.regexp_extract("text", pattern, group), F.lit("")).alias("field_value")))
    return documents.select("document_id", F.explode(F.array(*rows)).alias("r")).select("document_id", "r.*").where("field_value is not null")


def looked_up(groups: Column, path: str) -> Column:
    """Value at "group.field" of a map of maps, null where either is missing."""
    group, _, field = path.partition(".")
    return F.try_element_at(F.try_element_at(groups, F.lit(group)), F.lit(field))


def at_path(document: Column, path: str) -> Column:
    """Value of a JSON text at a dotted path that may hold positions, as results[0].x."""
    return F.get_json_object(document, f"$.{path}")


def result_view(model_jobs: DataFrame) -> DataFrame:
    """(document_id, job_type, status, created_at, completed_at, job_id, result, error_message) of a model's jobs to one row per document: the last job of each task, the prefix llm_ taken off."""
    own = model_jobs.where(F.col("job_type").like("llm\\_%")).withColumn("task", F.regexp_replace("job_type", "^llm_", ""))
    job = F.struct("job_id", "status", "created_at", "completed_at", "result", "error_message")
    last = own.groupBy("document_id", "task").agg(F.max_by(job, F.struct("created_at", "job_id")).alias("job"))
    return last.groupBy("document_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "job")))).alias("results"))
