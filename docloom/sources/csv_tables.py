"""CSV files as page tables: every row as an array of strings, in file order.

A quoted cell may hold line breaks, so whether a line begins a row depends on all quotes before it. Files
are read by lines and in splits all the same: each split counts its quotes, and for either
answer to "does it begin inside quotes" how many rows begin in it. Sums over the splits of a file, a few
numbers each, then tell for every split where it stands, and one file of any size is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.session import with_checkpoints

PLACE = ["file", "block"]


def _unescaped(text: Column, escape: str) -> Column:
    """The text without characters behind the escape sign. Doubled quotes need no care: they close and open again."""
    return text if escape == '"' else F.regexp_replace(text, f"(?s)\\Q{escape}\\E.", "")


def _quotes(line: Column, escape: str) -> Column:
    return F.regexp_count(_unescaped(line, escape), F.lit('"'))


def _blank() -> Column:
    return F.rtrim(F.col("line"), F.lit("\r")) == ""


def _cells_in(raw: Column, escape: str) -> Column:
    """Cells of a raw row: separators outside quotes, and one."""
    plain = F.regexp_replace(_unescaped(raw, escape), r'"[^"]*"', "")
    return F.regexp_count(plain, F.lit(",")) + 1


def _lines(spark: SparkSession, folders: str | list[str], escape: str) -> DataFrame:
    """file, block (where the split starts), at (order inside of it), line, quotes before the line in the split."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(folders).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"),
    )
    before = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("quotes", F.coalesce(F.sum(_quotes(F.col("line"), escape)).over(before), F.lit(0)))


def _starts(lines: DataFrame, escape: str) -> DataFrame:
    """file, block, inside (whether the split begins inside quotes), rows (that begin before it in the file)."""
    even = F.count_if((F.col("quotes") % 2 == 0) & ~_blank()).alias("even")
    odd = F.count_if((F.col("quotes") % 2 == 1) & ~_blank()).alias("odd")
    total = F.max_by(F.col("quotes") + _quotes(F.col("line"), escape), "at").alias("total")
    blocks = lines.groupBy(*PLACE).agg(even, odd, total)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("inside", F.coalesce(F.sum("total").over(before), F.lit(0)) % 2 == 1)
    begun = F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even"))
    return placed.select(*PLACE, "inside", F.coalesce(F.sum(begun).over(before), F.lit(0)).alias("rows"))


def csv_records(spark: SparkSession, folders: str | list[str], escape: str = '"') -> DataFrame:
    """file, row_index, raw: the text of every row of the files in a folder or in folders.

    Lines of a row are joined inside their split; only the pieces at the ends of splits meet others.
    Empty lines outside quotes are no rows.
    """
    lines = _lines(spark, folders, escape)
    begins = (F.col("quotes") + F.col("inside").cast("int")) % 2 == 0
    placed = lines.join(_starts(lines, escape), PLACE).filter(~(begins & _blank()))
    upto = Window.partitionBy(*PLACE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = placed.withColumn("row", F.col("rows") + F.count_if(begins).over(upto) - 1)
    whole = Window.partitionBy(*PLACE)
    numbered = numbered.withColumn("last", F.max("row").over(whole))
    piece = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda p: p["line"]), "\n")
    pieces = numbered.groupBy(*PLACE, "row").agg(
        piece.alias("piece"), F.first((F.col("row") < F.col("rows")) | (F.col("row") == F.col("last"))).alias("at_end")
    )
    inner = pieces.filter(~F.col("at_end")).select("file", "row", F.col("piece").alias("raw"))
    ends = pieces.filter("at_end").groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("p"))
    joined = ends.select("file", "row", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("raw"))
    rows = inner.unionByName(joined)
    return rows.select("file", F.col("row").alias("row_index"), F.rtrim(F.col("raw"), F.lit("\r")).alias("raw"))


def read_csv_rows(spark: SparkSession, folders: str | list[str], escape: str = '"') -> DataFrame:
    """source_file, row_index, cells. Row 0 is the header row.

    Each row has its own cells: files and rows of different width lose none and gain none, an empty cell is
    null. Quotes inside a quoted cell are doubled, or follow the escape sign if another is given. A quote that
    is never closed makes the rest of its file one row. Rows are put together once and written, since the
    widest one sets the columns they are parsed into.
    """
    with_checkpoints(spark)
    records = csv_records(spark, folders, escape).checkpoint()
    width = records.agg(F.max(_cells_in(F.col("raw"), escape))).first()[0] or 1
    schema = ", ".join(f"_c{i} string" for i in range(width))
    options = {"mode": "PERMISSIVE", "multiLine": "true", "escape": escape, "maxColumns": str(max(20480, width + 1))}
    parsed = F.from_csv("raw", schema, options)
    cells = F.array(*[F.col(f"row._c{i}") for i in range(width)])
    own = F.least(_cells_in(F.col("raw"), escape), F.lit(width))
    return records.select("file", "row_index", "raw", parsed.alias("row")).select(
        tx.base_name(F.col("file")).alias("source_file"), "row_index", F.slice(cells, F.lit(1), own).alias("cells")
    )
