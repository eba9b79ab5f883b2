"""Work that is dear per row does not stay in the few tasks that its bytes would give it."""

from pyspark.sql import functions as F

from byline.operators import affiliations, panels, regions
from byline.session import task_count


def test_texts_in_one_partition_are_dealt_over_all_tasks(spark):
    texts = spark.createDataFrame([(str(i), f"1. School of {i}, X\n2. Institute, Y") for i in range(40)], "doi string, text string").coalesce(1)
    for out in (affiliations.extract_affiliation_blocks(texts),
                panels.extract_panel_affiliations(texts.select("doi", F.lit(1).alias("pos"), F.lit("Ann Lee").alias("name"), "text"))):
        assert out.rdd.getNumPartitions() >= task_count(spark)
    assert affiliations.extract_affiliation_blocks(texts).count() == 80


def test_regions_make_no_grams_of_items(spark, capsys):
    box = F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")))
    items = spark.createDataFrame([("a", 1, "ann lee"), ("a", 2, "bo chen"), ("b", 1, "ann lee")], "doi string, item int, text string").withColumn("box", box)
    names = spark.createDataFrame([("a", "Ann Xu"), ("a", "Lee"), ("b", "Bo")], "doi string, name string")
    pages = spark.createDataFrame([("a", 9, 9), ("b", 9, 9)], "doi string, width int, height int")
    out = regions.layout_regions(items, names, pages)
    assert [(r.doi, r.region) for r in out.collect()] == [("a", "author")]
    out.explain()
    assert "xxhash64" not in capsys.readouterr().out
