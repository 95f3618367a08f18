from vecsql.operators.index import Catalog
from vecsql.streaming.append import append_stream, delete_stream

SCHEMA = "id long, vec array<float>"


def test_batches_go_in_once(spark, tmp_path):
    source, catalog = str(tmp_path / "source"), Catalog(spark, f"file://{tmp_path}/indexes")
    rows = lambda a, b: spark.createDataFrame([(i, [float(i), 1.0]) for i in range(a, b)], SCHEMA).coalesce(1)
    rows(0, 5).write.parquet(source)
    catalog.create("i", "t", spark.createDataFrame([], SCHEMA), "vec", "id")
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    append_stream(catalog, "i", stream, str(tmp_path / "check"), once=True).awaitTermination()
    assert catalog.count("i") == 5
    rows(5, 8).write.mode("append").parquet(source)
    append_stream(catalog, "i", stream, str(tmp_path / "check"), once=True).awaitTermination()
    assert catalog.count("i") == 8 and catalog.get("i").extra["last_batch"] == 1
    # the same batches from a checkpoint that was lost: numbers it has seen are passed over
    append_stream(catalog, "i", stream, str(tmp_path / "other"), once=True).awaitTermination()
    assert catalog.count("i") == 8
    gone = str(tmp_path / "gone")
    spark.createDataFrame([(1,), (7,)], "id long").write.parquet(gone)
    delete_stream(catalog, "i", spark.readStream.schema("id long").parquet(gone), str(tmp_path / "check2"), once=True).awaitTermination()
    assert catalog.count("i") == 6
    assert [r.key for r in catalog.search("i", [7.0, 1.0], 1, exact=True).collect()] == [6]
