"""Files are written by tasks and committed as a whole."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import committed, workbook


def listed(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def test_files_are_committed_once(spark, tmp_path):
    rows = [(f"d{i % 3}/f{i}.bin", bytearray(b"x" * i)) for i in range(20)] + [("none", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    committed.write_files(df, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == sorted(n for n, c in rows if c is not None)
    assert (tmp_path / "out" / "d1" / "f7.bin").read_bytes() == b"x" * 7
    assert [d for d in os.listdir(tmp_path / "out") if d.startswith("_")] == []
    # A file that is there already: nothing is written; with overwrite it is replaced.
    again = spark.createDataFrame([("d1/f7.bin", bytearray(b"new")), ("d9", bytearray(b""))], "name string, content binary")
    with pytest.raises(Exception, match="one name"):
        committed.write_files(again, str(tmp_path / "out"))
    assert (tmp_path / "out" / "d1" / "f7.bin").read_bytes() == b"x" * 7 and not (tmp_path / "out" / "d9").exists()
    committed.write_files(again, str(tmp_path / "out"), overwrite=True)
    assert (tmp_path / "out" / "d1" / "f7.bin").read_bytes() == b"new" and len(listed(tmp_path / "out")) == 21
    committed.write_files(df.limit(0), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists() or listed(tmp_path / "empty") == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    fails = F.when(F.col("id") == 90, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).cast("binary")
    df = spark.range(0, 100, 1, 4).select(F.concat(F.lit("f"), "id").alias("name"), fails.alias("content"))
    with pytest.raises(Exception, match="broken"):
        committed.write_files(df, str(tmp_path / "out"))
    assert listed(tmp_path / "out") == []


def test_attempts_that_are_run_again_leave_no_double(tmp_path):
    """Two attempts of one task have written; the driver was told of one."""
    from pyspark.sql import Row

    writer = committed._FileWriter(str(tmp_path / "out"), False)
    rows = [Row(name="a", content=b"1"), Row(name="b", content=b"2")]
    writer.write(iter(rows))
    told = writer.write(iter(rows))
    writer.commit([told, None])
    assert listed(tmp_path / "out") == ["a", "b"]
    with pytest.raises(ValueError, match="one name"):
        other = committed._FileWriter(str(tmp_path / "two"), False)
        other.commit([other.write(iter(rows)), other.write(iter(rows[:1]))])
    assert listed(tmp_path / "two") == []


def test_books_and_crops(spark, tmp_path):
    fields = workbook.REVIEW_COLUMNS
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (600).to_bytes(4, "big") + (400).to_bytes(4, "big")
    records = spark.range(7).select(
        F.when(F.col("id") < 5, "batch/1").otherwise("b 2").alias("batch_id"),
        F.format_string("in/f%d.png", 9 - F.col("id")).alias("file_id"),
        F.lit(1).alias("page_no"),
        F.lit(1).alias("region_no"),
        *[(F.array(F.lit("n1"), F.lit("n2")) if f == "notes" else F.lit("invoice") if f == "doc_kind" else F.concat(F.lit("v"), "id")).alias(f) for f in fields],
        F.lit("red").alias("colour"),
        F.when(F.col("id") % 2 == 0, F.lit(png)).alias("crop"),
    )
    committed.write_review_books(records, str(tmp_path / "out"), ["batch_id"], most=3)
    assert listed(tmp_path / "out") == ["b_2-review-00000.xlsx", "batch_1-review-00000.xlsx", "batch_1-review-00001.xlsx"]
    cells = workbook.read_book((tmp_path / "out" / "batch_1-review-00000.xlsx").read_bytes())
    place = next(i for i, f in enumerate(fields) if f not in ("notes", "doc_kind"))
    # Rows follow the path.
    assert [cells[f"{chr(65 + place)}{n}"] for n in (2, 3, 4)] == ["v4", "v3", "v2"]
    assert cells[f"{chr(65 + fields.index('notes'))}2"] == "n1; n2"
    committed.write_crops(records.select("file_id", "page_no", "region_no", "crop"), str(tmp_path / "crops"))
    found = listed(tmp_path / "crops")
    assert len(found) == 4 and all(f.endswith("/p1-r1.png") for f in found)
    assert (tmp_path / "crops" / found[0]).read_bytes() == png
