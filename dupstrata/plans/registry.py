"""Named analyses over a trace's files and chunks, and custom ones by module and function.

An analysis is a function of (files, chunks) and options that returns a DataFrame or a dict of them by name; it builds a
plan and runs nothing.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dupstrata.functions.scalars import size_class
from dupstrata.operators import harnik, redundancy, statistics
from dupstrata.operators.chunking import zero_digests

Result = dict[str, DataFrame]
ANALYSES: dict[str, Callable[..., Result]] = {}
ALIASES = {"harnik": "harniks", "tr-harniks": "harniks-tr"}
#: These take a list of generations and no other analysis beside them.
TEMPORAL = ("tr", "harniks-tr")


def register_analysis(name: str, fn: Callable[..., Result]) -> None:
    ANALYSES[name] = fn


def analysis(name: str) -> Callable[..., Result]:
    """By registered name, or `module:function`."""
    name = ALIASES.get(name, name)
    if name in ANALYSES:
        return ANALYSES[name]
    module, colon, function = name.partition(":")
    if not colon:
        raise ValueError(f"unknown analysis {name!r}; known: {', '.join(sorted(ANALYSES))}")
    return getattr(importlib.import_module(module), function)


def _add(name: str) -> Callable:
    def add(fn: Callable[..., Result]) -> Callable[..., Result]:
        register_analysis(name, fn)
        return fn

    return add


def classed(rows: DataFrame) -> DataFrame:
    return rows if "size_class" in rows.columns else rows.withColumn("size_class", size_class("filesize"))


@_add("simple")
def simple(files: DataFrame, chunks: DataFrame, **_) -> Result:
    return {"totals": redundancy.simple_totals(files, chunks), "files": redundancy.simple_per_file(files, chunks)}


@_add("ir")
def ir(files: DataFrame, chunks: DataFrame, **_) -> Result:
    """Both breakdowns from one aggregate over (fp, type, class): its rows are shared by two small regroupings."""
    cost = redundancy.first_cost(classed(chunks), ["filetype", "size_class"])
    return {"type": redundancy.by_key_and_all(cost, "filetype"), "size": redundancy.by_key_and_all(cost, "size_class")}


@_add("tr")
def tr(files: DataFrame, chunks: DataFrame, **_) -> Result:
    """chunks: of all generations, with gen counting from 0."""
    c = classed(chunks)
    return {"type": redundancy.temporal(c, "filetype").where("gen > 0"), "size": redundancy.temporal(c, "size_class").where("gen > 0")}


@_add("full-file")
def full_file(files: DataFrame, chunks: DataFrame, **_) -> Result:
    return {"totals": redundancy.full_file(files, chunks)}


@_add("file-stats")
def file_stats(files: DataFrame, chunks: DataFrame, **_) -> Result:
    return {"files": statistics.file_statistics(files)}


@_add("file-details")
def file_details(files: DataFrame, chunks: DataFrame, **_) -> Result:
    f = classed(files)
    return {"type": statistics.file_details(f, "filetype"), "size": statistics.file_details(f, "size_class")}


@_add("chunk-size-stats")
def chunk_size_stats(files: DataFrame, chunks: DataFrame, **_) -> Result:
    return {"sizes": statistics.chunk_sizes(chunks)}


@_add("zero-chunk")
def zero_chunk(files: DataFrame, chunks: DataFrame, zero_fps: Sequence[str] | None = None, **_) -> Result:
    return {"totals": redundancy.zero_chunks(chunks, zero_fps or zero_digests())}


@_add("validate")
def validate(files: DataFrame, chunks: DataFrame, **_) -> Result:
    return {"totals": statistics.validate(files, chunks)}


@_add("harniks")
def harniks(files: DataFrame, chunks: DataFrame, sample_size: int | None = None, breakdown: bool = False, seed: str = "1", **_) -> Result:
    by = [c for c in ("run", "file_seq", "chunk_seq") if c in chunks.columns]
    sample = harnik.compact(harnik.draw(chunks, sample_size or (harnik.SAMPLE_WITH_BREAKDOWN if breakdown else harnik.SAMPLE), seed, by))
    out = {"totals": harnik.estimate(sample, chunks)}
    if breakdown:
        c = classed(chunks)
        out |= {"type": harnik.estimate(sample, c, "filetype"), "size": harnik.estimate(sample, c, "size_class")}
    return out


@_add("harniks-tr")
def harniks_tr(files: DataFrame, chunks: DataFrame, sample_size: int | None = None, seed: str = "1", **_) -> Result:
    """Each generation against the one before it, by estimates of both together and of the earlier one."""
    by = [c for c in ("run", "file_seq", "chunk_seq") if c in chunks.columns]
    last = chunks.agg(F.max("gen")).first()[0] or 0
    return {f"gen-{g}": harnik.estimate_temporal(chunks.where(F.col("gen").isin(g - 1, g)), chunks.where(F.col("gen") == g - 1), sample_size or harnik.SAMPLE, seed, by) for g in range(1, last + 1)}


@_add("ir-fast")
def ir_fast(files: DataFrame, chunks: DataFrame, **_) -> Result:
    return {"totals": redundancy.fast_totals(chunks)}


@_add("ir-mode")
def ir_mode(files: DataFrame, chunks: DataFrame, **_) -> Result:
    c = classed(chunks)
    return {"type": redundancy.mode_attributed(c, "filetype"), "size": redundancy.mode_attributed(c, "size_class")}


@_add("ir-exact")
def ir_exact(files: DataFrame, chunks: DataFrame, **_) -> Result:
    data = redundancy.chunk_data(chunks)
    return {"type": redundancy.exact_attributed(data, "filetype"), "size": redundancy.exact_attributed(data, "filelength")}
