import pytest

from pagespring import plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(name, spark, data, same_as_sql):
    same_as_sql(plans.QUERIES[name](spark, data), plans.SQL[name], data)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def copied(folder, name, rows):
    """A folder with ``rows`` as its table of this name."""
    rows.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_projector_where_a_tile_lacks_patches(spark, data, same_as_sql, tmp_path):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    folder = copied(tmp_path, "embeddings", e.where("vec_id < 83 or vec_id in (188, 190)"))
    same_as_sql(plans.QUERIES["projector"](spark, folder), plans.SQL["projector"], folder)


@pytest.mark.parametrize("name", ["region_scale_f32", "region_crop_rect", "region_crop_wrap"])
def test_pixels_above_32_bits(name, spark, data, same_as_sql, tmp_path):
    """Text that begins with digits makes the marker before it a large number."""
    d = spark.read.parquet(f"{data}/documents.parquet")
    text = "CASE WHEN doc_id % 4 = 0 THEN '9999999999' || text WHEN doc_id % 4 = 1 THEN '1234567' || text ELSE text END AS text"
    folder = copied(tmp_path, "documents", d.selectExpr("doc_id", text, "lang", "source", "n_chars"))
    same_as_sql(plans.QUERIES[name](spark, folder), plans.SQL[name], folder)
