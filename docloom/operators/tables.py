"""Tables found on pages.

Input pages: doc_id, source_file, page_number, text, tables (array of tables, each an
array of rows of cells). All steps are array expressions on the page row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import fixed_values as fv
from docloom.functions import text as tx


def clean_cell(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"(?U)\s+", " "))


def clean_rows(table: Column, drop_empty: bool = True) -> Column:
    """Cells without null and surplus blanks; null rows and (optionally) empty rows removed."""
    rows = F.filter(table, lambda row: row.isNotNull())
    rows = F.transform(rows, lambda row: F.transform(row, clean_cell))
    if not drop_empty:
        return rows
    return F.filter(rows, lambda row: F.exists(row, lambda cell: cell != ""))


def _filled_cells(table: Column) -> Column:
    return F.size(F.filter(F.flatten(table), lambda cell: F.trim(F.coalesce(cell, F.lit(""))) != ""))


def _cells(table: Column) -> Column:
    return F.size(F.flatten(table))


def is_valid(table: Column) -> Column:
    """Two rows, a first column and three filled cells in ten."""
    enough = _filled_cells(table) / F.nullif(_cells(table), F.lit(0)) >= F.lit(fv.MIN_FILLED_RATIO)
    return F.coalesce(
        (F.size(table) >= 2) & (F.size(F.get(table, F.lit(0))) >= 1) & enough, F.lit(False)
    )


def is_plausible(table: Column) -> Column:
    """The weaker test used while parsing: two rows and one filled cell."""
    rows = F.filter(table, lambda row: row.isNotNull())
    return F.coalesce((F.size(table) >= 2) & (_filled_cells(rows) >= 1), F.lit(False))


def has_even_width(table: Column) -> Column:
    return F.size(F.array_distinct(F.transform(table, F.size))) <= 2


def _header_has(table: Column, kind: str) -> Column:
    """No word holds a line feed, so the joined header matches just where one of its cells does."""
    words = "|".join(fv.TABLE_HEADER_WORDS[kind])
    return F.lower(F.array_join(F.get(table, F.lit(0)), "\n")).rlike(words)


def _first_rows(table: Column) -> Column:
    """Lower-case text of the two rows after the header."""
    return F.lower(F.array_join(F.flatten(F.slice(table, 2, 2)), " "))


def is_pricing(table: Column) -> Column:
    return _header_has(table, "pricing") | _first_rows(table).rlike(fv.CURRENCY_IN_CELLS)


def is_itinerary(table: Column) -> Column:
    return _header_has(table, "itinerary") | _first_rows(table).rlike(fv.TIME_IN_CELLS)


def is_specification(table: Column) -> Column:
    return _header_has(table, "specifications")


def is_menu(table: Column) -> Column:
    return _header_has(table, "menu")


def is_inventory(table: Column) -> Column:
    return _header_has(table, "inventory")


def table_type(table: Column) -> Column:
    """The first matching kind, otherwise general."""
    return (
        F.when(is_pricing(table), "pricing")
        .when(is_itinerary(table), "itinerary")
        .when(is_specification(table), "specifications")
        .when(is_menu(table), "menu")
        .when(is_inventory(table), "inventory")
        .otherwise("general")
    )


def confidence(table: Column, kind: Column) -> Column:
    shaped = (F.size(table) > 2) & (F.size(F.get(table, F.lit(0))) > 1)
    zero = F.lit(0.0)
    score = F.lit(0.5) + F.when(shaped, F.lit(0.2)).otherwise(zero)
    score = score + F.when(kind != "general", F.lit(0.2)).otherwise(zero)
    return F.least(score, F.lit(1.0))


def raw_tables(pages: DataFrame) -> DataFrame:
    """One row per raw table; the index counts tables that later turn out invalid."""
    return _exploded(pages, F.col("tables"), "raw")


def _exploded(pages: DataFrame, tables: Column, name: str) -> DataFrame:
    exploded = pages.select("doc_id", "source_file", "page_number", "text", F.posexplode(tables).alias("table_index", name))
    table_id = F.concat(
        F.lit("tbl_"), "doc_id", F.lit("_p"), "page_number", F.lit("_"), "table_index"
    )
    return exploded.withColumn("table_id", table_id)


def clean_tables(pages: DataFrame) -> DataFrame:
    """Cleaned, valid tables with the page columns.

    Tables are cleaned before they become rows: the filter and the columns made from a cleaned table then read
    it, while a column that cleans would be worked out again at each of their mentions.
    """
    cleaned = F.transform("tables", lambda raw: clean_rows(raw))
    return _exploded(pages, cleaned, "table").filter(is_valid(F.col("table")))


def extract_tables(pages: DataFrame) -> DataFrame:
    """Structured tables: headers, rows, type, context, confidence and shape."""
    table = F.col("table")
    typed = clean_tables(pages).withColumn("table_type", table_type(table))
    return typed.select(
        "table_id",
        F.col("source_file").alias("source_doc"),
        F.col("page_number").alias("source_page"),
        F.get(table, F.lit(0)).alias("headers"),
        F.expr("slice(table, 2, size(table))").alias("rows"),
        "table_type",
        F.substring(tx.or_empty(F.col("text")), 1, fv.TABLE_CONTEXT_CHARS).alias("context"),
        confidence(table, F.col("table_type")).alias("confidence"),
        F.size(table).alias("row_count"),
        F.size(F.get(table, F.lit(0))).alias("column_count"),
    )


def tables_of_type(tables: DataFrame, kind: str) -> DataFrame:
    return tables.filter(F.col("table_type") == kind)


def count_by_type(tables: DataFrame) -> DataFrame:
    return tables.groupBy("table_type").agg(F.count("*").alias("tables"))
