"""The filter before joins loses no key and drops most others."""

from byline.llm.staging import likely_in


def test_likely_keys(spark):
    rows = spark.range(200_000).selectExpr("id", "unhex(md5(cast(id as string))) AS node", "'x' AS _extra")
    keys = rows.where("id % 1000 = 7").select("node")
    left = likely_in(rows, keys, "node")
    assert left.columns == rows.columns
    ids = {r.id for r in left.collect()}
    assert ids >= set(range(7, 200_000, 1000)) and len(ids) < 300
    assert likely_in(rows, keys.limit(0), "node").count() == 0
