from pyspark.sql import functions as F

from sedimenta.plans import catalog
from sedimenta.sources.corpus import payload_corpus


def test_every_source_is_clustered(spark, small):
    got = catalog.cluster_payloads(spark, small).select("idx", "leader").collect()
    want = payload_corpus(spark, small).where("payload_id is not null and payload is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {}
    for r in got:
        counts[catalog.CLUSTERED[r.idx // 10**12]] = counts.get(catalog.CLUSTERED[r.idx // 10**12], 0) + 1
    assert counts == {r.source: r.n for r in want}
    assert set(counts) == set(catalog.CLUSTERED)
