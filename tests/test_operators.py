import pytest
from pyspark.sql import functions as F

from dupstrata.operators import harnik, reassemble, redundancy, statistics

# Three files; b repeats chunks of a, and one chunk is held by all.
CHUNKS = [
    ("r", 1, 0, "A", 10, "txt", 30, 0), ("r", 1, 1, "B", 20, "txt", 30, 0),
    ("r", 2, 0, "B", 20, "doc", 50, 1), ("r", 2, 1, "C", 30, "doc", 50, 1),
    ("r", 3, 0, "B", 20, "txt", 20, 2),
]
SCHEMA = "run string, file_seq long, chunk_seq long, fp string, chunksize long, filetype string, filesize long, gen long"


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, SCHEMA)


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("r", 1, "txt", 30), ("r", 2, "doc", 50), ("r", 3, "txt", 20), ("r", 4, "txt", 0)], "run string, file_seq long, filetype string, filesize long")


def keyed(df, *cols):
    return {r["key"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_first_occurrence(chunks):
    assert keyed(redundancy.internal(chunks, "filetype"), "real", "total") == {"txt": (30, 50), "doc": (30, 50), "ALL": (60, 100)}


def test_simple(files, chunks):
    assert redundancy.simple_totals(files, chunks).first().asDict() == {"total_bytes": 100, "unique_bytes": 60, "redundant_bytes": 40, "redundancy_pct": 40.0, "n_chunks": 5, "mean_chunk": 20}
    rows = {r["file_seq"]: r for r in redundancy.simple_per_file(files, chunks).collect()}
    assert {k: (r["redundancy"], r["patch"], r["illegal"]) for k, r in rows.items()} == {1: (0, 30, False), 2: (20, 30, False), 3: (20, 0, False), 4: (0, 0, False)}
    with pytest.raises(Exception, match="add up"):
        redundancy.simple_per_file(files.withColumn("filesize", F.col("filesize") + 1), chunks, strict=True).collect()


def test_temporal(chunks):
    got = {(r["gen"], r["key"]): (r["real"], r["total"]) for r in redundancy.temporal(chunks, "filetype").collect()}
    assert got[0, "ALL"] == (30, 30) and got[1, "ALL"] == (30, 50) and got[2, "ALL"] == (0, 20)


def test_attribution(chunks):
    mib = 1048576.0
    near = lambda got, want: all(abs(a - b / mib) < 1e-6 for a, b in zip(got, want, strict=True))
    by = keyed(redundancy.mode_attributed(chunks, "filetype"), "real_mib", "total_mib")
    assert near(by["txt"], (30, 70)) and near(by["doc"], (30, 30))
    by = keyed(redundancy.exact_attributed(redundancy.chunk_data(chunks), "filetype"), "real_mib", "total_mib")
    assert near(by["txt"], (10 + 40 / 3, 50)) and near(by["ALL"], (60, 100))


def test_full_file(spark, files, chunks):
    assert redundancy.full_file(files, chunks).first()["duplicate_files"] == 0
    more = chunks.unionByName(chunks.where("file_seq = 1").withColumn("file_seq", F.lit(5).cast("long")))
    both = files.unionByName(spark.createDataFrame([("r", 5, "doc", 30)], files.schema))
    r = redundancy.full_file(both, more).first()
    assert (r["duplicate_files"], r["duplicate_bytes"]) == (1, 30)


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 57])
def test_percentiles(spark, n):
    sizes = [(i * 7919) % 1000 * (1 + i % 3 * 500) for i in range(n)]
    got = statistics.order_statistics(spark.createDataFrame([(s,) for s in sizes], "x long"), "x").first()
    ordered = sorted(sizes)
    for p in statistics.PERCENTILES:
        at = p * n // 100
        assert got[f"p{p}"] == ordered[at] and got[f"c{p}"] == sum(ordered[: at + 1])


def test_empty_tables(spark, chunks, files):
    c, f = chunks.where("false"), files.where("false")
    assert redundancy.simple_totals(f, c).first()["redundancy_pct"] == 0.0
    assert redundancy.zero_chunks(c, ["A"]).first()["zero_pct"] is None
    assert statistics.validate(f, c).first().asDict() == {"file_bytes": 0, "n_files": 0, "n_chunks": 0}
    assert statistics.file_statistics(f).count() == 0
    assert harnik.draw(c, 10).count() == 0


def test_chunk_sizes_count_parts_as_large(chunks):
    got = {r["chunksize"]: (r["n"], r["n_large"]) for r in statistics.chunk_sizes(chunks.withColumn("partial", F.col("file_seq") == 2)).collect()}
    assert got == {10: (1, 0), 20: (3, 1), 30: (1, 1)}


def test_whole_sample_is_exact(chunks):
    sample = harnik.compact(harnik.draw(chunks, 100))
    assert harnik.estimate(sample, chunks).first()["ratio"] == 0.4
    for k in (1, 2, 3, 5):
        assert harnik.draw(chunks, k).count() == k
    assert abs(harnik.needed(1 / 3) - 445_656) < 2


def test_parts(spark):
    records = spark.createDataFrame([(0, "a", True, None), (1, "b", False, 5), (2, "a", True, None), (3, "a", False, 6), (4, "a", False, 2), (5, "b", True, None)], "record_seq long, filename string, partial boolean, filesize long")
    chunks = spark.createDataFrame([(0, 0, "A", 1), (0, 1, "B", 2), (2, 0, "C", 2), (3, 0, "D", 1), (4, 0, "A", 2), (1, 0, "E", 5), (5, 0, "F", 9)], "record_seq long, chunk_seq long, fp string, chunksize long")
    files, whole = reassemble.reassemble(records, chunks)
    assert {r["file_seq"] for r in files.collect()} == {1, 3, 4}
    got = {}
    for r in whole.orderBy("file_seq", "chunk_seq").collect():
        got.setdefault(r["file_seq"], []).append(r["fp"])
    assert got == {1: ["E"], 3: ["A", "B", "C", "D"], 4: ["A"]}


def test_moving_average_and_pairs(spark, chunks):
    rows = statistics.sliding_average(chunks, "chunksize", ["run"], ["file_seq", "chunk_seq"], 1).orderBy("file_seq", "chunk_seq").collect()
    assert [r["moving"] for r in rows] == [10.0, 15.0, 20.0, 25.0, 25.0]


def test_one_fingerprint_in_every_file(spark):
    """The first file pays for it; no task holds its occurrences."""
    n = 20_000
    files = spark.range(n).select(F.col("id").alias("file_seq"), F.lit(3).cast("long").alias("filesize"))
    chunks = files.select("file_seq", F.lit(0).cast("long").alias("chunk_seq"), F.lit("zero").alias("fp"), F.lit(2).cast("long").alias("chunksize")).unionAll(files.select("file_seq", F.lit(1).cast("long"), F.col("file_seq").cast("string"), F.lit(1).cast("long")))
    got = redundancy.simple_per_file(files, chunks)
    assert got.agg(F.sum("redundancy"), F.count_if("illegal"), F.count_if(F.col("redundancy") == 0)).first() == (2 * (n - 1), 0, 1)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_order_of_reports(spark):
    rows = spark.createDataFrame([("ALL", 5), ("16", 1), ("2", 9), ("pdf", 3), ("doc", 9)], "key string, total long")
    assert [r["key"] for r in redundancy.ordered(rows).collect()] == ["2", "16", "doc", "pdf", "ALL"]
    assert [r["key"] for r in redundancy.ordered(rows, "total").collect()] == ["2", "doc", "ALL", "pdf", "16"]
