"""Chunking: fixed-size by built-in expressions, content-defined by a vectorised rolling hash; and digests of chunks.

Both give one row a chunk: the columns of the file's key, chunk_seq, offset, chunksize and fp (lower-case hex).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KIB = 1024
#: Rows that a chunking task gathers before it hands them on.
OUT_ROWS = 10_000
DIGESTS = {"MD5": 16, "SHA-1": 20, "SHA-224": 28, "SHA-256": 32, "SHA-384": 48, "SHA-512": 64}


@dataclass(frozen=True)
class Digest:
    """A hash of data and salt, cut to its first `length` bytes."""

    kind: str = "SHA-1"
    length: int | None = None
    salt: bytes = b""

    def __post_init__(self) -> None:
        if self.kind not in DIGESTS:
            raise ValueError(f"unknown digest {self.kind!r}; known: {', '.join(DIGESTS)}")
        if self.length is not None and not 0 < self.length <= DIGESTS[self.kind]:
            raise ValueError(f"{self.kind} has {DIGESTS[self.kind]} bytes, not {self.length}")

    @property
    def size(self) -> int:
        return self.length or DIGESTS[self.kind]

    def column(self, data: Column) -> Column:
        salted = F.concat(data, F.lit(self.salt)) if self.salt else data
        full = F.md5(salted) if self.kind == "MD5" else F.sha1(salted) if self.kind == "SHA-1" else F.sha2(salted, int(self.kind[4:]))
        return F.substring(full, 1, 2 * self.size)

    def of(self, data: bytes) -> str:
        return hashlib.new(self.kind.replace("-", "").lower(), data + self.salt).hexdigest()[: 2 * self.size]


def fixed_chunks(files: DataFrame, body: str, size: int, keys: Sequence[str], digest: Digest = Digest()) -> DataFrame:
    """Cuts every `size` bytes; the tail is shorter and there is no empty chunk."""
    n = F.octet_length(body).cast("long")
    at = files.where(n > 0).select(*keys, F.col(body).alias("_body"), F.posexplode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size) * size, F.lit(size).cast("long"))).alias("chunk_seq", "offset"))
    piece = F.substr("_body", (F.col("offset") + 1).cast("int"), F.lit(size))
    cut = at.select(*keys, F.col("chunk_seq").cast("long").alias("chunk_seq"), "offset", piece.alias("_piece"))
    return cut.select(*keys, "chunk_seq", "offset", F.octet_length("_piece").cast("long").alias("chunksize"), digest.column(F.col("_piece")).alias("fp"))


# The irreducible polynomial of the rolling hash (degree 63) and its window in bytes.
POLYNOMIAL, WINDOW = 13827942727904890243, 48


def poly_mod(a: int, p: int) -> int:
    """The remainder of polynomials over GF(2)."""
    n = p.bit_length()
    while a.bit_length() >= n:
        a ^= p << (a.bit_length() - n)
    return a


def poly_mulmod(a: int, b: int, p: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        b >>= 1
        a = poly_mod(a << 1, p)
    return poly_mod(out, p)


def append_table(p: int = POLYNOMIAL) -> list[int]:
    """What the byte that leaves the top adds, and clears: for each j, j x**k mod p with the bits of j above, k the degree."""
    k = p.bit_length() - 1
    base = poly_mod(1 << k, p)
    return [(poly_mulmod(j, base, p) | (j << k)) & (2**64 - 1) for j in range(256)]


def window_table(p: int = POLYNOMIAL, window: int = WINDOW) -> list[int]:
    """What a byte that leaves the window takes out: b x**(8 (window - 1)) mod p."""
    shift = poly_mod(1 << (8 * (window - 1)), p)
    return [poly_mulmod(b, shift, p) for b in range(256)]


def place_tables(p: int = POLYNOMIAL, window: int = WINDOW) -> np.ndarray:
    """For each place k back from the last byte and each byte b: b x**(8 k) mod p. The hash of a window is their XOR."""
    out = np.zeros((window, 256), np.uint64)
    for k in range(window):
        shift = poly_mod(1 << (8 * k), p)
        bits = [poly_mulmod(1 << i, shift, p) for i in range(8)]
        for b in range(256):
            v = 0
            for i in range(8):
                if b >> i & 1:
                    v ^= bits[i]
            out[k, b] = v
    return out


#: A plain table and not a cached function, as it travels to executors by value together with the functions that use it.
_LOW: dict[str, np.ndarray] = {}


def low_tables() -> np.ndarray:
    """The low 32 bits, which hold every mask."""
    if "low" not in _LOW:
        _LOW["low"] = place_tables().astype(np.uint32)
    return _LOW["low"]


@dataclass(frozen=True)
class Rabin:
    """Content-defined chunks: least, mean and most bytes. A chunk's hash starts `least` - 48 bytes after its begin."""

    least: int
    mean: int
    most: int

    @property
    def mask(self) -> int:
        return (1 << (self.mean.bit_length() - 1)) - 1

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """The windowed hash after each byte, low 32 bits, as if the window began full of zeros."""
        tables = low_tables()
        out = np.zeros(len(data), np.uint32)
        for k in range(min(WINDOW, len(data))):
            out[k:] ^= tables[k][data[: len(data) - k]]
        return out

    def cuts(self, raw: bytes) -> list[int]:
        """Ends of the chunks."""
        data = np.frombuffer(raw, np.uint8)
        n, mask = len(data), np.uint32(self.mask)
        skip = max(0, self.least - WINDOW)
        block = 4 << 20  # hashes of so many bytes are held at a time
        ends, begin = [], 0
        low, marks = 0, np.zeros(0, np.int64)
        high = 0
        while begin < n:
            first, last = begin + skip, min(begin + self.most, n)
            cut = last
            # The first bytes after the skip see a window that is not full yet: only what was hashed counts.
            early = np.flatnonzero(self.hashes(data[first : min(first + WINDOW - 1, last)]) & mask == mask)
            if len(early):
                cut = first + int(early[0]) + 1
            else:
                at = first + WINDOW - 1
                while at < last:
                    if not low <= at < high:
                        low, high = at, min(n, at + block)
                        h = self.hashes(data[max(0, low - WINDOW + 1) : high])[low - max(0, low - WINDOW + 1) :]
                        marks = np.flatnonzero(h & mask == mask) + low
                    k = int(np.searchsorted(marks, at))
                    if k < len(marks) and marks[k] < last:
                        cut = int(marks[k]) + 1
                        break
                    at = high
            ends.append(cut)
            begin = cut
        return ends


#: Chunkers by name: fixed2 to fixed64 and cdc2 to cdc64, in KiB; a content-defined one is at least a quarter and at most four times its mean.
CHUNKERS: dict[str, int | Rabin | Callable[[bytes], list[int]]] = {f"fixed{k}": k * KIB for k in (2, 4, 8, 16, 32, 64)} | {f"cdc{k}": Rabin(k * KIB // 4, k * KIB, k * KIB * 4) for k in (2, 4, 8, 16, 32, 64)}
DEFAULT_CHUNKER = "cdc8"


def register_chunker(name: str, chunker: int | Rabin | Callable[[bytes], list[int]]) -> None:
    """A size, a Rabin, or a function from bytes to the ends of their chunks."""
    CHUNKERS[name] = chunker


def ends_of(chunker: int | Rabin | Callable[[bytes], list[int]], raw: bytes) -> list[int]:
    if not raw:
        return []
    if isinstance(chunker, int):
        return [*range(chunker, len(raw), chunker), len(raw)]
    return chunker.cuts(raw) if isinstance(chunker, Rabin) else list(chunker(raw))


def chunk_files(files: DataFrame, body: str, keys: Sequence[str], chunkers: Sequence[str] = (DEFAULT_CHUNKER,), digest: Digest = Digest()) -> DataFrame:
    """Several chunkers over one read of the bytes: adds the column chunker. Files stay where they are; nothing is shuffled."""
    chosen = [(name, CHUNKERS[name]) for name in chunkers]
    if len(chosen) == 1 and isinstance(chosen[0][1], int):
        return fixed_chunks(files, body, chosen[0][1], keys, digest).withColumn("chunker", F.lit(chosen[0][0]))
    kinds = dict(files.dtypes)
    fields = [*[f"`{k}` {kinds[k]}" for k in keys], "chunk_seq long", "offset long", "chunksize long", "fp string", "chunker string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Some files' chunks go out together, OUT_ROWS and a file more at most."""
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]  # row in batch, place, begin, size, digest, chunker

            def flush() -> pa.RecordBatch:
                row, *rest = cols  # noqa: B023
                at = pa.array(row, pa.int32())
                out = [*[batch.column(k).take(at) for k in keys], *[pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]]  # noqa: B023
                for c in cols:  # noqa: B023
                    c.clear()
                return pa.RecordBatch.from_arrays(out, names=[*keys, "chunk_seq", "offset", "chunksize", "fp", "chunker"])

            for i in range(batch.num_rows):
                raw = batch.column("_body")[i].as_py() or b""
                for name, chunker in chosen:
                    ends = ends_of(chunker, raw)
                    begins = [0, *ends[:-1]] if ends else []
                    for c, more in zip(cols, ([i] * len(ends), range(len(ends)), begins, [b - a for a, b in zip(begins, ends, strict=True)], [digest.of(raw[a:b]) for a, b in zip(begins, ends, strict=True)], [name] * len(ends)), strict=True):
                        c.extend(more)
                if len(cols[0]) >= OUT_ROWS:
                    yield flush()
            yield flush()

    return files.select(*keys, F.col(body).alias("_body")).mapInArrow(run, ", ".join(fields))


def zero_digests(chunkers: Sequence[str] = ("cdc2", "cdc4", "cdc8"), digests: Sequence[Digest] = (Digest(), Digest(length=10))) -> list[str]:
    """Digests of the first chunk of an all-zero file, derived from the chunkers themselves."""
    found = []
    for name in chunkers:
        chunker = CHUNKERS[name]
        most = chunker if isinstance(chunker, int) else chunker.most if isinstance(chunker, Rabin) else 64 * KIB
        raw = bytes(most)
        end = ends_of(chunker, raw)[0]
        found += [d.of(raw[:end]) for d in digests]
    return found
