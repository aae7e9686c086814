"""Exports: guarded rows as CSV, JSON, HTML and spreadsheet XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def guarded(requested: DataFrame, documents: DataFrame, eav: DataFrame) -> DataFrame:
    """(document_id) with the reason why it can't be exported: not_found, not_completed, no_data, or null. Case of the status is ignored."""
    rows = eav.groupBy("document_id").agg(F.count("*").alias("n"))
    met = requested.join(documents.select("document_id", "status"), "document_id", "left").join(rows, "document_id", "left")
    reason = F.when(F.col("status").isNull(), "not_found").when(F.lower("status") != "completed", "not_completed").when(F.col("n").isNull(), "no_data")
    return met.select("document_id", reason.alias("reason"))


def pairs(eav: DataFrame) -> DataFrame:
    return eav.select("document_id", F.col("field_name").alias("field"), F.col("field_value").alias("value"))


def to_csv(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    """CSV files with a header, CRLF line ends and doubled quotes."""
    rows.write.option("header", True).option("sep", delimiter).option("escape", '"').option("lineSep", "\r\n").csv(path)


def to_json(rows: DataFrame, path: str) -> None:
    """JSON lines, which stay distributed."""
    rows.write.json(path)


def json_array(rows: DataFrame) -> DataFrame:
    """One JSON array of (field, value) per document."""
    return rows.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("json"))


def escaped(value: Column) -> Column:
    """Text made safe for HTML and XML."""
    out = F.coalesce(value, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def html_table(rows: DataFrame) -> DataFrame:
    """One HTML table of (field, value) per document."""
    line = F.concat(F.lit("<tr><td>"), escaped(F.col("field")), F.lit("</td><td>"), escaped(F.col("value")), F.lit("</td></tr>"))
    body = F.array_join(F.array_sort(F.collect_list(line)), "")
    return rows.groupBy("document_id").agg(F.concat(F.lit("<table><tr><th>field</th><th>value</th></tr>"), body, F.lit("</table>")).alias("html"))


def spreadsheet(rows: DataFrame) -> DataFrame:
    """One SpreadsheetML workbook of (field, value) per document, as text."""
    cell = lambda c: F.concat(F.lit('<Cell><Data ss:Type="String">'), escaped(c), F.lit("</Data></Cell>"))
    line = F.concat(F.lit("<Row>"), cell(F.col("field")), cell(F.col("value")), F.lit("</Row>"))
    head = '<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="data"><Table>'
    body = F.array_join(F.array_sort(F.collect_list(line)), "")
    return rows.groupBy("document_id").agg(F.concat(F.lit(head), body, F.lit("</Table></Worksheet></Workbook>")).alias("workbook"))


#: Formats on offer; PDF is made elsewhere from the HTML table.
FORMATS = ("excel", "csv", "json", "pdf")


def flattened(rows: DataFrame, sep: str = ".") -> DataFrame:
    """Nested columns as top-level ones with dotted names; in lists of structs each item is flattened, other lists stay."""

    def members(column: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind for c in members(column.getField(f.name), f.dataType, f"{name}{sep}{f.name}" if name else f.name)]
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            column = F.transform(column, lambda x: F.struct(*members(x, kind.elementType, "")))
        return [column.alias(name)]

    return rows.select(*[c for f in rows.schema for c in members(F.col(f"`{f.name}`"), f.dataType, f.name)])


def flat(structured: DataFrame) -> DataFrame:
    """(document_id, group_name, field, value) to dotted keys."""
    return structured.select("document_id", F.concat_ws(".", "group_name", "field").alias("key"), "value")


def append_rows(eav: DataFrame, path: str, day: str) -> None:
    """EAV rows added to a table partitioned by the day they came."""
    eav.withColumn("day", F.lit(day)).write.mode("append").partitionBy("day").parquet(path)
