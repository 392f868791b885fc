from sedimenta.session import BATCH_BYTES, BATCH_KEY


def test_arrow_batches_are_bounded_by_bytes(spark):
    """10,000 texts of 4 KB are several batches, not one of 40 MB; all rows come."""
    from sedimenta.session import ship

    ship(spark)
    assert int(spark.conf.get(BATCH_KEY)) <= BATCH_BYTES
    docs = spark.range(0, 10_000, 1, 1).selectExpr("id", "repeat('abcd', 1024) AS t")

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(b)]), pa.array([b.nbytes])], names=["n", "size"])

    rows = docs.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == 10_000 and max(r.size for r in rows) <= 2 * BATCH_BYTES
