import os

from pyspark.sql import functions as F

from pricetail.operators.cells import CELL_KEY, join_modes
from pricetail.sources import read_months, replace_months, write_bucketed, write_months


def _cells(spark, n=2000):
    ids = spark.range(n)
    return ids.select(
        (F.col("id") % 3 + 6).cast("int").alias("month"), (F.col("id") % 11).cast("int").alias("week"),
        (F.col("id") % 97).alias("sku_gtin"), (F.col("id") % 13).cast("string").alias("store_id"), F.col("id").alias("quantity"),
    )


def _files(root):
    return {
        (month, name): os.stat(os.path.join(root, month, name)).st_mtime_ns
        for month in os.listdir(root) if month.startswith("month=") for name in os.listdir(os.path.join(root, month))
    }


def test_replace_months_leaves_other_months_alone(spark, tmp_path):
    root = str(tmp_path / "cells")
    cells = _cells(spark)
    write_months(cells.where("month < 8").withColumn("quantity", F.lit(-1).cast("long")), root)
    before = _files(root)
    corrected = cells.where("month in (7, 8)")
    for _ in range(2):  # a reload can be repeated
        replace_months(corrected, root)
    after = _files(root)
    assert {k: v for k, v in before.items() if k[0] == "month=6"} == {k: v for k, v in after.items() if k[0] == "month=6"}
    got = {r["month"]: (r["n"], r["q"]) for r in read_months(spark, root).groupBy("month").agg(F.count("*").alias("n"), F.sum("quantity").alias("q")).collect()}
    want = {r["month"]: (r["n"], r["q"]) for r in corrected.groupBy("month").agg(F.count("*").alias("n"), F.sum("quantity").alias("q")).collect()}
    assert got == want | {6: (667, -667)}
    # Nothing to load changes nothing.
    replace_months(corrected.limit(0), root)
    assert _files(root) == after


def test_bucketed_tables_join_and_group_without_shuffle(spark, tmp_path):
    cells = write_bucketed(_cells(spark), str(tmp_path / "cells"), CELL_KEY, 6)
    modes = _cells(spark).where("quantity % 2 = 0").withColumn("ppu", F.col("quantity") / 4)
    modes = write_bucketed(modes, str(tmp_path / "modes"), CELL_KEY, 6)
    joined = join_modes(cells, modes.hint("merge"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    plain = join_modes(_cells(spark), spark.read.parquet(str(tmp_path / "modes")))
    assert sorted(joined.collect()) == sorted(plain.collect())
    grouped = cells.groupBy(*CELL_KEY).count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    # One file a bucket, however many tasks there were.
    names = [n for n in os.listdir(tmp_path / "cells") if n.endswith(".parquet")]
    assert len(names) == 6
