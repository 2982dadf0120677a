import os

import pytest
from pyspark.sql import functions as F

from tamarack.sources.catalog import analyze, save


def test_a_load_takes_the_place_of_the_old_table_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    save(spark.range(10), path, ["id"])
    save(spark.read.parquet(path).where("id < 4"), path)  # made from itself
    assert spark.read.parquet(path).count() == 4
    broken = spark.range(5).select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        save(broken, path)
    assert spark.read.parquet(path).count() == 4
    save(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and sum(".old-" in n for n in os.listdir(tmp_path)) == 0


def test_statistics(spark, tmp_path):
    path = str(tmp_path / "s")
    save(spark.range(50).selectExpr("id", "id % 5 AS k"), path)
    found = analyze(spark, "analyzed_s", path)
    assert found.count() == 50
    text = " ".join(r.data_type or "" for r in spark.sql("DESCRIBE EXTENDED analyzed_s").collect())
    assert "50 rows" in text
    column = {r.info_name: r.info_value for r in spark.sql("DESCRIBE EXTENDED analyzed_s k").collect()}
    assert column["distinct_count"] == "5" and column["max"] == "4"
    spark.sql("DROP TABLE analyzed_s")
    assert spark.read.parquet(path).count() == 50
