from coilworks.operators import units


def test_conditions_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "temp", "20", "C")], "cond_row bigint, var_type string, val string, val_units string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = units.condition_values(stream).writeStream.format("memory").queryName("standard").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("standard").collect()] == [(1, "temperature", 29315)]
