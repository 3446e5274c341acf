import time

from dupstrata.plans.reporting import Reporter, observed


def test_counters_come_with_the_plan(spark):
    df = spark.createDataFrame([(10,), (20,)], "chunksize long")
    same, seen = observed(df)
    assert same.count() == 2 and seen.get == {"n_chunks": 2, "chunk_bytes": 30}


def test_reporter(spark):
    said = []
    with Reporter(spark, 0.05, said.append, 0.01):
        time.sleep(0.2)
    n = len(said)
    assert n >= 2 and "tasks" in said[0]
    with Reporter(spark, 0, said.append):
        pass
    assert len(said) == n
