"""From lines to reviewed records: the whole plan, lazily, up to a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import consensus, layout, linkage, records, rows
from ..operators.lineage import cut
from ..operators.rows import REGION


def regions(lines: DataFrame, settings: Settings = Settings(), text_layer: bool = False) -> DataFrame:
    """Lines with region_no: text-layer blocks, or receipts; pages to which neither applies are one region."""
    usable = rows.usable_lines(lines)
    if not settings.segment:
        return usable.withColumn("region_no", F.lit(1))
    if text_layer:
        return layout.segment_text_lines(usable).where("region_no is not null")
    found = layout.cluster_receipts(usable, settings.dpi / 200)
    whole = found.groupBy(*layout.PAGE).agg(F.max("region_no").alias("most"))
    placed = found.join(whole, layout.PAGE).withColumn("region_no", F.when(F.col("most").isNull(), 1).otherwise(F.col("region_no"))).drop("most")
    return layout.strip_edge_bleed(placed.where("region_no is not null"), REGION)


def parsed(placed: DataFrame, settings: Settings = Settings(), source: str = "ocr") -> DataFrame:
    """Records of lines with region_no, not yet linked; with the strategy of their page, if lines have one."""
    k = settings.keywords
    placed = cut(placed)
    clustered = rows.cluster_rows(placed).drop("members")
    if settings.segment:
        clustered = rows.split_stacked(clustered, k["total"] + k["tendered"])
    else:
        clustered = clustered.withColumn("part", F.lit(0))
    found = records.parse_rows(clustered, settings, [*REGION, "part"])
    if "strategy" in placed.columns:
        found = found.join(placed.groupBy("file_id", "page_no").agg(F.first("strategy").alias("strategy")), ["file_id", "page_no"])
    found = records.worth_keeping(cut(found))
    name = F.concat_ws("#", "file_id", "page_no", "region_no", "part")
    # The input order without numbering all rows in one task.
    order = F.struct("file_id", "page_no", "region_no", "part")
    return found.withColumn("record_id", name).withColumn("source_file", name).withColumn("ord", order).withColumn("source", F.lit(source))


def extract(lines: DataFrame, settings: Settings = Settings(), text_layer: bool = False) -> DataFrame:
    """Records of all receipts on the pages of ``lines``, not yet linked."""
    return parsed(regions(lines, settings, text_layer), settings, "text" if text_layer else "ocr")


def finish(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Linked, year-repaired and enriched for review.

    Records are checkpointed before linkage and before repair: each of these reads
    them several times, and texts must not be recognised or parsed again.
    """
    linked = linkage.deduplicate(cut(found), settings.link)
    return consensus.enrich_review(cut(consensus.repair_years(cut(linked))))
