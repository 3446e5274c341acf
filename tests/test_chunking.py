import hashlib
import random

import pytest

from dupstrata.operators import chunking as C


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_golden_tables():
    t, w = C.append_table(), C.window_table()
    assert [signed(t[i]) for i in (0, 1, 2, 10, 11)] == [0, -4618801345804661373, 9209141382100228870, 4671215262765932955, -56922619018187752]
    assert (signed(w[1]), signed(w[131])) == (3516854836665139219, 846774551824259960)
    assert C.poly_mulmod(1, 4604570691050114435, C.POLYNOMIAL) == 4604570691050114435


def slow_cuts(raw, c):
    """Byte by byte, by the rules of the rolling hash."""
    t, u, ends, begin = C.append_table(), C.window_table(), [], 0
    while begin < len(raw):
        f, ring, at, cut = 0, [0] * C.WINDOW, 0, min(begin + c.most, len(raw))
        for i in range(begin + max(0, c.least - C.WINDOW), cut):
            f ^= u[ring[at]]
            ring[at], at = raw[i], (at + 1) % C.WINDOW
            f = ((f << 8 | raw[i]) & (1 << 64) - 1) ^ t[f >> 55]
            if f & c.mask == c.mask:
                cut = i + 1
                break
        ends.append(cut)
        begin = cut
    return ends


@pytest.mark.parametrize("c", [C.CHUNKERS["cdc2"], C.Rabin(0, 256, 1024), C.Rabin(64, 128, 512)])
def test_cuts_as_byte_by_byte(c):
    raw = random.Random(3).randbytes(120_000)
    assert c.cuts(raw) == slow_cuts(raw, c)
    assert c.cuts(b"") == [] and c.cuts(b"x") == [1]


def test_mean_size_without_least():
    raw = random.Random(1).randbytes(4 << 20)
    ends = C.Rabin(0, 8192, 128 << 10).cuts(raw)
    assert 7 << 10 <= len(raw) / len(ends) <= 9 << 10


def test_zero_chunks():
    assert C.zero_digests(digests=(C.Digest(),)) == ["0631457264ff7f8d5fb1edc2c0211992a67c73e6", "897256b6709e1a4da9daba92b6bde39ccfccd8c1", "5188431849b4613152fd7bdba6a3ff0a4fd6424b"]


def test_shifted_copy_shares_most_chunks():
    body = random.Random(5).randbytes(1 << 20)
    prints = lambda raw: {hashlib.sha1(raw[a:b]).digest(): b - a for e in [C.CHUNKERS["cdc8"].cuts(raw)] for a, b in zip([0, *e[:-1]], e, strict=True)}
    a, b = prints(body), prints(random.Random(6).randbytes(4096) + body)
    total = sum(a.values()) + sum(b.values())
    assert 0.45 <= 1 - sum((a | b).values()) / total <= 0.5


def test_digests(spark):
    with pytest.raises(ValueError):
        C.Digest("MD4")
    with pytest.raises(ValueError):
        C.Digest("MD5", 17)
    from pyspark.sql import functions as F

    for kind in C.DIGESTS:
        d = C.Digest(kind, 8, b"salt")
        assert spark.range(1).select(d.column(F.lit("abc").cast("binary"))).first()[0] == d.of(b"abc")


def test_several_chunkers_in_one_read(spark):
    raw = random.Random(2).randbytes(40_000)
    C.register_chunker("halves", lambda b: [len(b) // 2, len(b)])
    files = spark.createDataFrame([(1, raw), (2, b""), (3, None)], "id long, body binary")
    rows = C.chunk_files(files, "body", ("id",), ("cdc2", "fixed4", "halves")).collect()
    by = {n: sorted((r["offset"], r["chunksize"]) for r in rows if r["chunker"] == n) for n in ("cdc2", "fixed4", "halves")}
    assert {r["id"] for r in rows} == {1} and by["halves"] == [(0, 20_000), (20_000, 20_000)]
    assert all(sum(s for _, s in v) == len(raw) for v in by.values())
    plain = C.fixed_chunks(files, "body", 4096, ("id",)).collect()
    assert sorted((r["offset"], r["chunksize"]) for r in plain) == by["fixed4"]
    assert {r["fp"] for r in plain} == {r["fp"] for r in rows if r["chunker"] == "fixed4"}
