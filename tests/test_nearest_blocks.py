from spanloom.operators import vectors


def test_one_matrix_at_a_time(spark):
    """Over many blocks and packs, with ties that cross them."""
    rows = [(i, [float(i % 7) + 1, float(i % 5), 1.0]) for i in range(300)]
    e = vectors.with_unit(spark.createDataFrame(rows, "id long, embedding array<double>")).select("id", "unit")
    q = e.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    one, many = (sorted((r.query_id, r["rank"], r.id, r.cosine) for r in vectors.nearest(q, e.repartition(5), 3, block).collect()) for block in (1 << 13, 4))
    assert [x[:3] for x in one] == [x[:3] for x in many] and len(one) == 90
    assert one[0][2] == 35 and {x[2] for x in one if x[0] == 0} == {35, 70, 105}


def test_memory_of_a_product_is_bounded(spark):
    e = vectors.with_unit(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "id long, embedding array<double>")).select("id", "unit")
    vectors.nearest(e.withColumnRenamed("id", "query_id"), e, 1).collect()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= vectors.PACK
