"""Objects of a list inside large JSON documents, read by as many tasks as the files have splits.

A file is read as pieces between opening braces, which Spark's text source cuts out of any split. Whether a piece starts
inside a string, and how deep it lies, follows from running sums of quotes and brackets over the pieces before it; a piece
whose brace opens an object at the wanted depth starts a record. A record is then put together from its own pieces only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.operators.prefix import running_sum
from placewise.session import written

#: Weight of a square bracket in the one number that counts both kinds; braces have the weight 1.
SQUARE = 1 << 32


def _depth(outside):
    """Opened less closed brackets of a text without strings."""
    count = lambda c: (F.length(outside) - F.length(F.replace(outside, F.lit(c), F.lit("")))).cast("bigint")
    return (count("[") - count("]")) * SQUARE - count("}")


def json_records(spark: SparkSession, path: str, lists: int, objects: int) -> DataFrame:
    """(file_no, pos, doc): each object that opens inside ``lists`` lists and ``objects`` objects, in the order of its file.

    ``[meta, [entry, ...]]`` holds its entries inside (2, 0), ``{"features": [feature, ...]}`` inside (1, 1). Every list at
    that depth counts. Files are numbered from 0 by path and records from 0 in their file; files without records have none.
    ``doc`` starts with the object, and what follows up to the next piece is left on it: parsers read one object.
    Strings may hold any brackets, quotes and escapes.
    """
    raw = spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("piece"),
    )
    parts = F.split(F.regexp_replace("piece", r"(?s)\\.", ""), '"', -1)
    outside = lambda odd: F.array_join(F.filter(parts, lambda _, i: i % 2 == odd), "")
    pieces = written(raw.select(
        "file", "block", "id", "piece", (F.size(parts) - 1).cast("bigint").alias("quotes"), _depth(outside(0)).alias("from_out"), _depth(outside(1)).alias("from_in"),
    ), "pieces")
    blocks = pieces.groupBy("file", "block").agg(F.min("id").alias("first"))
    # a split of n bytes starts n + 1 pieces at most, so these numbers are in order and apart
    numbered = pieces.drop("piece").join(blocks, ["file", "block"]).withColumn("at", F.col("block") * 2 + F.col("id") - F.col("first"))
    quoted = running_sum(numbered, ["file"], "at", "quotes", "upto")
    outer = (F.col("upto") - F.col("quotes")) % 2 == 0
    opened = F.when(outer & (F.col("at") > 0), 1).otherwise(0).cast("bigint")
    moved = quoted.select("file", "id", "at", opened.alias("opened"), F.when(outer, F.col("from_out")).otherwise(F.col("from_in")).alias("change"))
    deep = running_sum(moved.withColumn("step", F.col("opened") + F.col("change")), ["file"], "at", "step", "after")
    starts = (F.col("opened") == 1) & (F.col("after") - F.col("change") == lists * SQUARE + objects + 1)
    within = F.col("after") - F.col("change") >= lists * SQUARE + objects + 1
    marked = deep.select("file", "id", "at", F.when(starts, 1).otherwise(0).cast("bigint").alias("start"), (within | (F.col("opened") == 0)).alias("within"))
    placed = running_sum(marked, ["file"], "at", "start", "record").where("record > 0 and within").select("id", "file", "record", "at")
    texts = placed.join(pieces.select("id", "piece"), "id").groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("_p"))
    files = pieces.select("file").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("file")).cast("bigint") - 1)
    doc = F.concat(F.lit("{"), F.array_join(F.transform("_p", lambda p: p["piece"]), "{"))
    return texts.join(files, "file").select("file_no", (F.col("record") - 1).alias("pos"), doc.alias("doc"))
