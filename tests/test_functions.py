from pyspark.sql import functions as F

from dupstrata.functions import scalars as S


def values(spark, rows, fn, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn("x")).collect()]


def test_file_types(spark):
    names = [".asadmintruststore", "src/timer.d", "resume.DOC", "resume.DOC~", "x.jpeg1~", "a.b/c", "x.a:b", "none", "x.", None]
    assert values(spark, names, S.normalized_file_type) == ["---", "d", "doc", "doc", "---", "---", "a-b", "---", "---", None]


def test_size_classes(spark):
    ns = [0, 1, 2, 3, 4, 1023, 1024, 1025, 1048576, 1048577, (1 << 48) - 1, 1 << 61, None]
    assert values(spark, ns, S.size_class, "long") == [0, 1, 2, 2, 4, 512, 1024, 1024, 1048576, 1048576, 1 << 47, 1 << 61, None]


def test_storage_units(spark):
    assert values(spark, [0, 1024, 1025, 1536, 3 << 20, 5 << 40], S.storage_unit, "long") == ["0", "1024", "1.00K", "1.50K", "3.00M", "5120.00G"]
    assert values(spark, ["7", "2k", "3M", "1G", "1t", "x"], S.parse_storage_unit) == [7, 2048, 3 << 20, 1 << 30, 1 << 40, None]


def test_java_hash(spark):
    def model(s):
        h = 0
        raw = s.encode("utf-16-be")
        for a, b in zip(raw[::2], raw[1::2], strict=True):
            h = (31 * h + (a << 8 | b)) & 0xFFFFFFFF
        return str(h - (1 << 32) if h >> 31 else h)

    names = ["", "a/a.txt", "Aa", "BB", "größe 😀", "x" * 300]
    assert values(spark, names, S.java_hash) == [model(n) for n in names]
    assert model("Aa") == model("BB")


def test_privacy(spark):
    import hashlib

    h = lambda s: hashlib.sha1(s.encode()).hexdigest()
    df = spark.createDataFrame([("a/a.txt",), ("/x/",)], "n string")
    assert [r[0] for r in df.select(S.private_name("n", "none")).collect()] == ["a/a.txt", "/x/"]
    assert [r[0] for r in df.select(S.private_name("n", "flat-sha1")).collect()] == [h("a/a.txt"), h("/x/")]
    assert [r[0] for r in df.select(S.private_name("n", "directory-sha1")).collect()] == [f"{h('a')}/{h('a.txt')}", f"{h('')}/{h('x')}"]
    import pytest

    with pytest.raises(ValueError):
        S.private_name("n", "rot13")


def test_hex(spark):
    df = spark.createDataFrame([(bytes([0, 0, 10, 0]),), (b"\0",)], "b binary")
    assert [r[0] for r in df.select(S.hex_digest("b")).collect()] == ["00000a00", "00"]
    assert [r[0] for r in df.select(S.compat_hex("b")).collect()] == ["0a00", "00"]


def test_sql_names(spark):
    S.register(spark)
    r = spark.sql("select file_size_category(1025), temporal_redundancy(1L, 3L, 10D), temporal_redundancy(null, 3L, 10D), most(array('b', 'a', 'a', 'b'))").first()
    assert r[0] == 1024 and tuple(r[1]) == (30.0, 0.0) and tuple(r[2]) == (30.0, 10.0) and r[3] == "a"
    assert spark.range(1).select(F.round(S.percent(F.lit(1), F.lit(0)), 2)).first()[0] == 0.0
