"""Visual rows and reading order of OCR lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import has_keyword, is_bare_time, is_header, strip

REGION = ["file_id", "page_no", "region_no"]


def usable_lines(lines: DataFrame, least_score: float = 0.45) -> DataFrame:
    """Lines that are not blank, not only a time of day, and scored well enough where scored."""
    return lines.where((F.coalesce("score", F.lit(1.0)) >= least_score) & (strip(F.col("text")) != "") & ~is_bare_time(F.col("text")))


def cluster_rows(lines: DataFrame, keys: list[str] = REGION) -> DataFrame:
    """Lines of each region gathered into visual rows.

    Columns: keys, row_no (0 from the top), text, x0, y0, x1, y1, members.  By rising
    centre, a line joins the first row whose mean centre lies within
    max(4, 0.6 * median height), else it opens a row: a fold over the sorted lines,
    since where one goes depends on those before it.  A region is one receipt, so its
    array is small; regions are grouped by one shuffle.
    """
    centre = (F.col("y0") + F.col("y1")) / 2
    line = F.struct(centre.alias("c"), F.col("line_no").alias("line_no"), strip(F.col("text")).alias("text"), "x0", "y0", "x1", "y1")
    grouped = lines.where(strip(F.col("text")) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.median(F.col("y1") - F.col("y0")).alias("height"))
    tolerance = F.greatest(F.lit(4.0), F.col("height") * 0.6)
    one = "struct<c:double,line_no:int,text:string,x0:double,y0:double,x1:double,y1:double>"
    empty = F.array().cast(f"array<struct<sum:double,n:int,members:array<{one}>>>")

    def place(rows: Column, item: Column) -> Column:
        near = F.transform(rows, lambda r: F.abs(item["c"] - r["sum"] / r["n"]) <= tolerance)
        alone = F.struct(item["c"].alias("sum"), F.lit(1).alias("n"), F.array(item).alias("members"))

        def put(at: Column) -> Column:
            grown = F.transform(
                rows,
                lambda r, i: F.when(i == at - 1, F.struct((r["sum"] + item["c"]).alias("sum"), (r["n"] + 1).alias("n"), F.array_append(r["members"], item).alias("members"))).otherwise(r),
            )
            return F.when(at > 0, grown).otherwise(F.array_append(rows, alone))

        return let(F.array_position(near, F.lit(True)).cast("int"), put)

    folded = F.aggregate("lines", empty, place)

    def shaped(row: Column) -> Column:
        by_x = F.array_sort(row["members"], lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).when(a["c"] < b["c"], -1).when(a["c"] > b["c"], 1).otherwise(a["line_no"] - b["line_no"]))
        edge = lambda name, pick: pick(F.transform(row["members"], lambda m: m[name])).alias(name)
        return F.struct(edge("y0", F.array_min), edge("x0", F.array_min), edge("x1", F.array_max), edge("y1", F.array_max), F.array_join(F.transform(by_x, lambda m: m["text"]), " ").alias("text"), by_x.alias("members"))

    # A stable sort by the rows' tops.
    rows = grouped.withColumn("rows", F.transform(folded, shaped)).select(*keys, F.posexplode(F.array_sort(F.transform("rows", lambda r, i: F.struct(r["y0"].alias("top"), i.alias("i"), r.alias("r"))))).alias("row_no", "s"))
    return rows.select(*keys, "row_no", *[F.col(f"s.r.{c}").alias(c) for c in ("text", "x0", "y0", "x1", "y1", "members")])


def split_stacked(rows: DataFrame, total_words: list[str], keys: list[str] = REGION) -> DataFrame:
    """Add ``part``: the number of the receipt within a region that holds several.

    A new part starts at the second and each later header row.  All or nothing: a
    region is split only if each part has four rows at least and a total or payment.
    """
    down = Window.partitionBy(*keys).orderBy("row_no")
    whole = Window.partitionBy(*keys)
    part = Window.partitionBy(*keys, "part")
    numbered = rows.withColumn("part", F.greatest(F.lit(0), F.sum(is_header(F.col("text")).cast("int")).over(down) - 1).cast("int"))
    good = (F.count(F.lit(1)).over(part) >= 4) & F.max(has_keyword(F.col("text"), total_words)).over(part)
    checked = numbered.withColumn("good", good)
    return checked.withColumn("part", F.when(F.min("good").over(whole), F.col("part")).otherwise(0)).drop("good")


def gap_islands(df: DataFrame, keys: list[str], position: str, flag: Column, least: int) -> DataFrame:
    """Runs of consecutive positions where ``flag`` holds, of ``least`` positions at least: keys, first, last, length."""
    order = Window.partitionBy(*keys).orderBy(position)
    marked = df.where(flag).withColumn("island", F.col(position) - F.row_number().over(order))
    runs = marked.groupBy(*keys, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= least).drop("island")
