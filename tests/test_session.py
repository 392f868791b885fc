from pathlib import Path

from sedimenta import session


def test_scratch_folders_are_released(spark):
    kept = session.scratch(spark, "kept")
    mark = session.scratch_mark(spark)
    gone = [session.scratch(spark, "gone") for _ in range(2)]
    for folder in (kept, *gone):
        spark.range(3).write.parquet(f"{folder}/x")
    session.release(spark, mark)
    session.discard(spark, f"{kept}/missing")
    session.release(spark, mark)
    assert [Path(f.removeprefix("file://")).exists() for f in (kept, *gone)] == [True, False, False]
    assert spark.read.parquet(f"{kept}/x").count() == 3


def test_rounds_of_components_take_few_jobs(spark):
    """Tables between rounds are read by their known schema: a chain of 8 takes fewer jobs on the driver."""
    from sedimenta.llm.graph import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few-jobs", "")
    try:
        roots = components(edges)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(sc.statusTracker().getJobIdsForGroup("few-jobs"))
    assert len({r.root for r in roots.collect()}) == 1 and roots.count() == 8
    assert jobs <= 60, jobs
