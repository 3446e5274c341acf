"""Command line: trace, parse, import, gpimport, validate, view. `python -m dupstrata.plans.cli COMMAND --help`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstrata.functions.scalars import PRIVACY, private_name, storage_unit
from dupstrata.operators import reassemble, redundancy, statistics
from dupstrata.operators.chunking import CHUNKERS, DEFAULT_CHUNKER, DIGESTS, Digest
from dupstrata.plans import registry
from dupstrata.plans.reporting import EVERY, Reporter
from dupstrata.sources import crawl, delimited, traces


#: Most chunks of a record that the trace writer makes.
PART_CHUNKS = 10_000


def load(spark: SparkSession, paths: Sequence[str], format: str) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of the traces, parts put together; traces count as one after another, and gen is a trace's place in paths."""
    records = None
    for gen, path in enumerate(paths):
        one = traces.read(spark, path, format).withColumn("gen", F.lit(gen)).withColumn("run", F.format_string("%06d:%s", F.lit(gen), F.col("run")))
        records = one if records is None else records.unionByName(one)
    files, chunks = reassemble.reassemble(records.drop("chunks"), traces.chunks(records).drop("filename", "filesize", "filetype", "partial"))
    meta = files.select("run", "file_seq", "gen", "filetype", "filesize")
    return files, chunks.drop("filename", "partial").join(meta.join(files.select("run", "file_seq", "filename"), ["run", "file_seq"]), ["run", "file_seq"])


def trace(spark: SparkSession, roots: Sequence[str], output: str | None = None, chunkers: Sequence[str] = (DEFAULT_CHUNKER,), digest: Digest = Digest(), label: str | None = None, listing: bool = False, follow_symlinks: bool = False, default_ignores: bool = True, relative: bool = False, privacy: str = "none", handler: str | None = None) -> dict[str, DataFrame]:
    """Crawls roots (or reads them from listing files), chunks the files, and writes a trace for each chunker or runs an analysis on it."""
    if output and handler:
        raise ValueError("an output and a handler exclude each other")
    pairs: list[tuple[str, str | None]] = [(r, label) for r in roots]
    if listing:
        pairs = [(r["path"], r["label"]) for path in roots for r in delimited.listing(spark, path, label).collect()]
    listed = crawl.list_files(spark, pairs, follow_symlinks, default_ignores)
    chunks = crawl.chunk_listing(listed.repartition(max(1, spark.sparkContext.defaultParallelism * 4)), chunkers, digest, relative)
    chunks = chunks.withColumn("filename", private_name("filename", privacy))
    out = {}
    for name in chunkers:
        one = chunks.where(F.col("chunker") == name)
        if output:
            traces.register(spark)
            # A long file is written in parts of PART_CHUNKS chunks; the record that closes it comes last, in the same trace file.
            part = F.coalesce(F.floor(F.col("chunk_seq") / PART_CHUNKS), F.lit(0)).cast("long")
            rows = one.where("error is null").groupBy("filename", "filesize", "filetype", "label", part.alias("part")).agg(F.array_sort(F.collect_list(F.when(F.col("fp").isNotNull(), F.struct("chunk_seq", "chunksize", "fp")))).alias("c"))
            last = one.where("error is null").groupBy(F.col("filename").alias("_name")).agg(F.coalesce(F.floor(F.max("chunk_seq") / PART_CHUNKS), F.lit(0)).cast("long").alias("_last"))
            body = F.transform("c", lambda x: F.struct(x["chunksize"].alias("chunksize"), F.unhex(x["fp"]).alias("fp"), F.lit(None).cast("long").alias("chunk_hash")))
            rows = rows.join(last, F.col("filename") == F.col("_name")).repartition("filename").sortWithinPartitions("filename", "part")
            rows = rows.select(F.lit("").alias("run"), F.lit(0).cast("long").alias("record_seq"), "filename", "filesize", "filetype", "label", (F.col("part") < F.col("_last")).alias("partial"), body.alias("chunks"))
            rows.write.format("trace").option("path", f"{output}-{name}" if len(chunkers) > 1 else output).mode("append").save()
        else:
            files = one.where("error is null").groupBy("filename", "filesize", "filetype", "label").agg(F.lit(1).alias("_")).withColumn("file_seq", F.xxhash64("filename")).drop("_")
            own = one.where("fp is not null").withColumn("file_seq", F.xxhash64("filename"))
            out |= {f"{name}-{k}": v for k, v in registry.analysis(handler or "simple")(files, own).items()}
    out["errors"] = chunks.where("error is not null").select("filename", "filesize", "error").distinct()
    return out


def parse(spark: SparkSession, paths: Sequence[str], types: Sequence[str] = ("simple",), format: str = "protobuf", output: str | None = None, sample_size: int | None = None) -> dict[str, DataFrame]:
    """Runs analyses over traces; with output, breakdowns are also written as text below it."""
    types = [registry.ALIASES.get(t, t) for t in types]
    for t in registry.TEMPORAL:
        if t in types and (len(types) > 1 or len(paths) < 2):
            raise ValueError(f"{t} stands alone and needs two traces or more")
    if "simple" in types and output:
        raise ValueError("simple has no output")
    files, chunks = load(spark, paths, format)
    out = {f"{t}/{k}": v for t in types for k, v in registry.analysis(t)(files, chunks, sample_size=sample_size, breakdown=bool(output)).items()}
    if output:
        for k, v in out.items():
            v = redundancy.ordered(v) if "key" in v.columns else v.orderBy("chunksize") if "chunksize" in v.columns and k.startswith("chunk-size") else v
            lines = delimited.breakdown_lines(v) if {"key", "real", "total"} <= set(v.columns) and "gen" not in v.columns else v
            (delimited.write_lines(lines.coalesce(1), f"{output}-{k.replace('/', '-')}") if lines.columns == ["value"] else lines.coalesce(1).write.option("sep", ";").csv(f"{output}-{k.replace('/', '-')}"))
    return out


def view(spark: SparkSession, path: str, format: str = "protobuf", only_fingerprint: bool = False) -> DataFrame:
    """Chunks with their offsets in their files."""
    _, chunks = load(spark, [path], format)
    placed = statistics.with_offsets(chunks, ("run", "file_seq"))
    return placed.select("fp") if only_fingerprint else placed.select("filename", "chunk_seq", "fp", "begin", "chunksize", F.lower(F.hex("chunk_hash")).alias("chunk_hash"))


def show(df: DataFrame) -> None:
    """Breakdowns in the order of reports, sizes in units and the share that deduplication saves with two digits; other frames as they are."""
    if {"key", "real", "total"} <= set(df.columns):
        share = F.when(F.col("total") > 0, 100.0 * (1.0 - F.col("real") / F.col("total"))).otherwise(F.lit(0.0))
        text = lambda c: F.concat(storage_unit(c), F.lit("B"))
        title = F.when(F.expr("try_cast(key as bigint)").isNotNull(), text(F.expr("try_cast(key as bigint)"))).otherwise(F.col("key"))
        df = redundancy.ordered(df).select(*[c for c in ("gen",) if c in df.columns], title.alias("key"), text(F.col("real")).alias("real"), text(F.col("total")).alias("total"), F.format_string("%.2f%%", share).alias("ratio"))
    df.show(50, False)


def main(args: Sequence[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="dupstrata")
    top.add_argument("--report", type=float, default=EVERY, help="seconds between lines of progress; 0 for none")
    sub = top.add_subparsers(dest="command", required=True)
    t = sub.add_parser("trace")
    t.add_argument("roots", nargs="+")
    t.add_argument("-o", "--output")
    t.add_argument("-c", "--chunker", action="append", choices=sorted(CHUNKERS))
    t.add_argument("--digest-type", default="SHA-1", choices=sorted(DIGESTS))
    t.add_argument("--digest-length", type=int)
    t.add_argument("--salt", default="")
    t.add_argument("--label")
    t.add_argument("--listing", action="store_true")
    t.add_argument("--follow-symlinks", action="store_true")
    t.add_argument("--no-default-ignores", action="store_true")
    t.add_argument("--relative", action="store_true")
    t.add_argument("--privacy-mode", default="none", choices=sorted(PRIVACY))
    t.add_argument("--custom-handler")
    for name in ("parse", "import", "gpimport", "validate", "view"):
        p = sub.add_parser(name)
        p.add_argument("paths", nargs="+")
        p.add_argument("-f", "--format", default="protobuf", choices=sorted(traces.FORMATS))
        p.add_argument("-o", "--output", required=name in ("import", "gpimport"))
        if name == "parse":
            p.add_argument("-t", "--type", action="append")
            p.add_argument("--harnik-sample-size", type=int)
        if name == "import":
            p.add_argument("--compress", action="store_true")
        if name == "view":
            p.add_argument("--only-fingerprint", action="store_true")
    a = top.parse_args(args)
    spark = SparkSession.builder.appName("dupstrata").getOrCreate()
    if a.command == "trace":
        shown = trace(spark, a.roots, a.output, a.chunker or (DEFAULT_CHUNKER,), Digest(a.digest_type, a.digest_length, a.salt.encode()), a.label, a.listing, a.follow_symlinks, not a.no_default_ignores, a.relative, a.privacy_mode, a.custom_handler)
    elif a.command == "parse":
        shown = parse(spark, a.paths, a.type or ("simple",), a.format, a.output, a.harnik_sample_size)
    elif a.command == "view":
        shown = {"chunks": view(spark, a.paths[0], a.format, a.only_fingerprint)}
    else:
        files, chunks = load(spark, a.paths, a.format)
        shown = {}
        if a.command == "validate":
            records = traces.read(spark, list(a.paths), a.format)
            shown = {"totals": statistics.validate(traces.files(records), traces.chunks(records))}
        elif a.command == "import":
            delimited.export_import(files, chunks, a.output, "bzip2" if a.compress else None)
        else:
            delimited.write_lines(delimited.database_chunk_lines(chunks), f"{a.output}/chunks")
            delimited.write_lines(delimited.database_file_lines(files), f"{a.output}/files")
    with Reporter(spark, a.report):
        for name, df in shown.items():
            print(name)
            show(df)


if __name__ == "__main__":
    main()
