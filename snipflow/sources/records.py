"""JSON records of any layout, read in splits and numbered in file order.

A corpus may be one JSON array (on one line or printed over many), JSON lines, printed
objects one after the other, or a folder that mixes these. The text source reads all
of them cut at ``}``: a separator that Hadoop's readers find from any byte offset, so
one array of many gigabytes is as splittable as lines are, on any file system that
Spark reads. A piece ends a record if its ``}`` stands outside a string, which takes
the parity of quotes before it. A line break cannot stand within a JSON string, so the
parity starts anew on every line, and damage ends at the next line break.

Quote parity and the number of records before a piece are prefix sums on two levels:
within a split (a window of one split's pieces), and over splits (one row for each). A
line break in an open string ends a damaged record, and the next begins after it.
The same sums give a dense ``row_id`` in the order of files, by path, and of records
within them, without one task that sees them all.

Records are flat objects: of a nested one, the text up to its first inner ``}`` is kept
as a damaged record, and so is its rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "corrupt_record"
ROW_ID = "row_id"
_BETWEEN = r"[\s,\[\]}\x{FEFF}]"


def _quotes(text):
    """Number of quotes that are not escaped."""
    bare = F.regexp_replace(text, r"(?s)\\.", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Pieces with the quote parity at their end (_odd), as if the split began outside a string.

    _torn: a line break within the piece stands in a string (_torn_else: if the split
    begins in one); the record before it ends there, damaged."""
    p = (spark.read.option("lineSep", "}").text(paths)
         .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
         .withColumn("_at", F.monotonically_increasing_id()))
    p = p.withColumn("_lines", F.split("value", r"[\r\n]+")).withColumn("_n", F.size("_lines"))
    p = p.withColumn("_break", (F.col("_n") > 1).cast("int")).withColumn("_quotes", _quotes(F.element_at("_lines", -1)))
    within = Window.partitionBy("_file", "_block").orderBy("_at")
    p = p.withColumn("_line", F.sum("_break").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    on_line = Window.partitionBy("_file", "_block", "_line").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("_odd", F.sum("_quotes").over(on_line) % 2)
    # the last line of those between the piece's first and last that ends in a string
    inner = F.array_max(F.transform(F.slice("_lines", 2, F.greatest(F.col("_n") - 2, F.lit(0))),
                                    lambda x, i: F.when(_quotes(x) % 2 == 1, i + 1)))
    p = p.withColumn("_inner", inner).withColumn("_first", _quotes(F.get("_lines", F.lit(0))) + F.coalesce(F.lag("_odd").over(within), F.lit(0)))
    torn = lambda carry: (F.col("_break") == 1) & (F.col("_inner").isNotNull() | ((F.col("_first") + carry) % 2 == 1))
    begun = F.col("_line") == F.col("_break")          # the line began in an earlier split
    p = p.withColumn("_torn", torn(0)).withColumn("_torn_else", F.when(begun, torn(1)).otherwise(torn(0)))
    return p.withColumn("_blank", F.regexp_like("value", F.lit(f"^{_BETWEEN}*$")))


def _splits(pieces: DataFrame) -> DataFrame:
    """Per split: the quote parity it begins with and the records that end before it."""
    first, open_, blank = F.col("_line") == 0, F.col("_odd") == 1, F.col("_blank")
    s = pieces.groupBy("_file", "_block").agg(
        F.max("_break").alias("breaks"), F.max_by("_odd", "_at").alias("odd"), F.max_by("_blank", "_at").alias("blank"),
        (F.count(F.when(~open_ & ~blank, 1)) + F.count(F.when(F.col("_torn"), 1))).alias("outside"),
        (F.count(F.when(F.when(first, open_).otherwise(~open_) & ~blank, 1)) + F.count(F.when(F.col("_torn_else"), 1))).alias("inside"))
    order = Window.partitionBy("_file").orderBy("_block")
    s = s.withColumn("run", F.sum("breaks").over(order))
    s = s.withColumn("state", F.sum("odd").over(Window.partitionBy("_file", "run").orderBy("_block")) % 2)
    s = s.withColumn("_carry", F.lag("state", 1, 0).over(order))
    # an open string at a file's end is a record too, a damaged one
    s = s.withColumn("_end", F.lead("_block").over(order).isNull())
    ends = F.when(F.col("_carry") == 0, F.col("outside")).otherwise(F.col("inside"))
    s = s.withColumn("ends", ends + (F.col("_end") & ~F.col("blank") & (F.col("state") == 1)).cast("int"))
    # rows: one for each split of the input
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("_file", "_block", "_carry", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("_before"))


def read_records(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """One row per JSON object: the columns of ``schema``, row_id (dense, from 0, in file
    order), corrupt_record (the text of a record that does not parse, else null; its
    other columns are null)."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    pieces = _pieces(spark, [path] if isinstance(path, str) else path)
    p = pieces.join(_splits(pieces), ["_file", "_block"])
    odd = F.when(F.col("_line") == 0, (F.col("_odd") + F.col("_carry")) % 2).otherwise(F.col("_odd"))
    torn = F.when(F.col("_carry") == 0, F.col("_torn")).otherwise(F.col("_torn_else"))
    p = p.withColumn("_cut", torn.cast("int")).withColumn("_ends", F.col("_cut") + ((odd == 0) & ~F.col("_blank")).cast("int"))
    earlier = Window.partitionBy("_file", "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_no", F.col("_before") + F.coalesce(F.sum("_ends").over(earlier), F.lit(0)))
    # a torn piece ends one record and begins the next
    at = F.coalesce("_inner", F.lit(0)) + 1
    head = F.struct(F.col("_no").alias("no"), F.lit(0).alias("part"), F.array_join(F.slice("_lines", F.lit(1), at), "\n").alias("text"))
    tail = F.struct((F.col("_no") + 1).alias("no"), F.lit(1).alias("part"),
                    F.concat(F.array_join(F.slice("_lines", at + 1, F.col("_n")), "\n"), F.lit("}")).alias("text"))
    whole = F.struct(F.col("_no").alias("no"), F.lit(0).alias("part"), F.concat("value", F.lit("}")).alias("text"))
    p = p.select("_file", "_block", "_at", F.explode(F.when(F.col("_cut") == 1, F.array(head, tail)).otherwise(F.array(whole))).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_at", "x.part", "x.text"))), lambda x: x["text"]), "")
    r = p.groupBy("_file", F.col("x.no").alias(ROW_ID)).agg(text.alias("text"))
    r = r.withColumn("text", F.regexp_replace("text", f"^{_BETWEEN}+", "")).where("text <> ''")
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    r = r.withColumn("_r", F.from_json("text", full, {"columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"_r.{CORRUPT}")
    return r.select(*[F.when(bad.isNull(), F.col(f"_r.{f.name}")).alias(f.name) for f in schema.fields], ROW_ID, bad.alias(CORRUPT))
