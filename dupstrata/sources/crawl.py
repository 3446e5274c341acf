"""Crawling directories: a driver-side listing of names, and reading and chunking of the bytes in tasks.

Files are read in blocks inside a task, so no file has to fit in a row; a chunker sees a bounded carry and the next
block. Paths must be on storage that all executors mount.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from dupstrata.functions.scalars import normalized_file_type
from dupstrata.operators.chunking import CHUNKERS, DEFAULT_CHUNKER, Digest, Rabin, ends_of

IGNORED = ("/dev", "/proc")
BLOCK = 4 << 20
LISTED = "path string, source string, label string, filesize long, error string"


def walk(root: str, label: str | None = None, ignore: Sequence[str] = IGNORED, follow_symlinks: bool = False) -> Iterator[tuple]:
    """(path, source, label, size, error) of regular files, dot files included. The root's own link is followed; others only if asked, each folder once."""
    source = os.path.realpath(root)
    todo, seen = [source], set()
    while todo:
        at = todo.pop()
        try:
            info = os.stat(at)
            if stat.S_ISDIR(info.st_mode):
                if at in ignore or (info.st_dev, info.st_ino) in seen:
                    continue
                seen.add((info.st_dev, info.st_ino))
                todo += sorted((e.path for e in os.scandir(at) if follow_symlinks or not e.is_symlink()), reverse=True)
            elif stat.S_ISREG(info.st_mode):
                yield at, source, label, info.st_size, None if os.access(at, os.R_OK) else "unreadable"
        except OSError as e:
            yield at, source, label, 0, type(e).__name__


def relative(path: str, source: str) -> str:
    return path[len(source) + 1 :] if path.startswith(source + "/") else os.path.basename(path)


def list_files(spark: SparkSession, roots: Sequence[str | tuple[str, str | None]], follow_symlinks: bool = False, default_ignores: bool = True) -> DataFrame:
    rows = [r for root in roots for r in walk(*((root, None) if isinstance(root, str) else root), IGNORED if default_ignores else (), follow_symlinks)]
    return spark.createDataFrame(rows, LISTED)


def read_chunks(path: str, chunker: int | Rabin, digest: Digest) -> Iterator[tuple[int, int, str]]:
    """(offset, size, fingerprint) of a file's chunks; BLOCK bytes and one chunk's most are held at a time."""
    most = chunker if isinstance(chunker, int) else getattr(chunker, "most", None)
    begin, carry = 0, b""
    with open(path, "rb", buffering=0) as f:
        while True:
            block = f.read(BLOCK if most else -1)
            data = carry + block
            ends = ends_of(chunker, data)
            sure = ends if not block or not most else [e for e in ends if e <= len(data) - most]
            at = 0
            for e in sure:
                yield begin + at, e - at, digest.of(data[at:e])
                at = e
            begin, carry = begin + at, data[at:]
            if not block or (not most and not carry):
                return


def chunk_listing(listed: DataFrame, chunkers: Sequence[str] = (DEFAULT_CHUNKER,), digest: Digest = Digest(), relative_names: bool = False) -> DataFrame:
    """filename, filesize, label, chunker, chunk_seq, offset, chunksize, fp, error, filetype. A file that can't be read is one row with an error."""
    chosen = [(n, CHUNKERS[n]) for n in chunkers]
    schema = "filename string, filesize long, label string, chunker string, chunk_seq long, offset long, chunksize long, fp string, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, source, label, size, error in zip(*(batch.column(c).to_pylist() for c in ("path", "source", "label", "filesize", "error")), strict=True):
                name = relative(path, source) if relative_names else path
                for chunker, how in chosen:
                    rows: list[tuple] = []
                    try:
                        if error is None:
                            rows = [(name, size, label, chunker, i, *c, None) for i, c in enumerate(read_chunks(path, how, digest))]
                    except OSError as e:
                        error = type(e).__name__
                    rows = rows or [(name, size, label, chunker, None, None, None, None, error)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["filename", "filesize", "label", "chunker", "chunk_seq", "offset", "chunksize", "fp", "error"])

    return listed.mapInArrow(run, schema).withColumn("filetype", normalized_file_type("filename"))
