"""Secret scans by an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. A ledger in shared storage holds the findings of each
pair of blob and rule version; only pairs that it lacks are scanned, and findings are joined back to every row (path)
whose text is that blob. A later run over the same or a grown table scans new blobs only. The rule version is a digest of
the patterns themselves, so a changed rule begins a new part of the ledger.

Only addresses are shuffled. Texts are scanned where they are read: all of them where the ledger is new, else those whose
address is among the missing ones (sent to all tasks while they are BROADCAST_BLOBS at most; beyond, joined by address). A
task remembers the addresses it has scanned, so copies within a task are scanned once. Entries of a blob are equal, so a
retried or concurrent run that appends the same pair again changes nothing: readers take one entry for each blob.

Null text counts as empty and has no findings. Repeated ids stay repeated rows. An empty table gives an empty result. Very
long texts are scanned whole, one at a time. Only the id and the text column are read, so further columns of any name
(blob, spans, ...) do no harm.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstrata.llm.common import cut, drop, map_texts, shared_folder, there

#: Most missing addresses that are sent to every task: 32 bytes each.
BROADCAST_BLOBS = 500_000
#: Addresses that a task remembers.
MEMORY = 50_000

# The base rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
# Further rules of this operator; their spans follow the base kinds.
PEM = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.A)
URLCRED = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]{1,64}:[^\x20\x09-\x0D/@]{3,64}@", re.A)
KINDS = ("assign", "access", "hex", "pem", "jwt", "urlcred")
BASE_KINDS = 3

RULES_VERSION = hashlib.sha256(repr([p.pattern for p in (ASSIGN, ACCESS, HEX, PEM, JWT, URLCRED)] + [ASSIGN_LEAST, KINDS]).encode()).hexdigest()[:16]

HEX_ONLY = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))
FINDINGS = "blob binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """Spans as (start, kind, end), sorted; starts and ends in code points, end exclusive.

    Runs of [A-Z0-9] or [0-9a-f] that are too short are dropped as the longest run is what a greedy match takes, so
    asking for the least length in the pattern finds the same spans.
    """
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    found = []
    low = raw.lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if b"h" * 24 in raw.translate(HEX_ONLY):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if b"PRIVATE KEY" in raw:
        found += [(m.start(), 3, m.end()) for m in PEM.finditer(text)]
    if b"eyJ" in raw:
        found += [(m.start(), 4, m.end()) for m in JWT.finditer(text)]
    if b"://" in raw and b"@" in raw:
        found += [(m.start(), 5, m.end()) for m in URLCRED.finditer(text)]
    return sorted(found)


def digest(spans: list[tuple[int, int, int]]) -> dict:
    say = lambda kept: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in kept)
    base = [s for s in spans if s[1] < BASE_KINDS]
    counts = [sum(k == kind for _, k, _ in base) for kind in range(BASE_KINDS)]
    return {"n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_sha256": hashlib.sha256(say(base).encode()).hexdigest(), "spans": say(spans)}


def _address(text_col: str) -> F.Column:
    return F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")), 256))


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, blob): the address of each row's text."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _address(text_col).alias("blob"))


def scan(bodies: DataFrame) -> DataFrame:
    """Findings for each (blob, text), where the texts are; a blob that a task has scanned is not scanned there again."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        seen = run.__dict__.setdefault("seen", set())
        if len(seen) > MEMORY:
            seen.clear()
        rows = []
        for blob, raw in zip(batch.column("blob").to_pylist(), batch.column("text"), strict=True):
            if blob not in seen:
                seen.add(blob)
                raw = raw.as_py() or b""
                rows.append({"blob": blob} | digest(find(raw.decode("utf-8", "replace"), raw)))
        return {k: [r[k] for r in rows] for k in ("blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}

    return map_texts(bodies, run, FINDINGS)


def entries(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's findings under this rule version, one row a blob; None if it has none."""
    path = f"{ledger}/rules={RULES_VERSION}"
    fs, at = there(spark, path)
    if not fs.exists(at):
        return None
    return spark.read.schema(FINDINGS).parquet(path).groupBy("blob").agg(*[F.max(c).alias(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")])


def extend(spark: SparkSession, docs: DataFrame, ledger: str, text_col: str = "text") -> int:
    """Scans the blobs of docs that the ledger lacks under this rule version and adds them; returns how many it lacked (-1 for all of a new ledger)."""
    known = entries(spark, ledger)
    bodies = docs.select(_address(text_col).alias("blob"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    lacking, missing = -1, None
    if known is not None:
        missing = cut(bodies.select("blob").distinct().join(known.select("blob"), "blob", "left_anti"), "missing-blobs")
        lacking = missing.count()
        bodies = bodies.join(F.broadcast(missing) if lacking <= BROADCAST_BLOBS else missing.hint("merge"), "blob", "left_semi")
    if lacking:
        scan(bodies).write.mode("append").parquet(f"{ledger}/rules={RULES_VERSION}")
    if missing is not None:
        drop(missing)
    return lacking


def ledger_of(spark: SparkSession, table: str) -> str:
    """The ledger in the shared folder of the table that this name stands for."""
    return f"{shared_folder(spark)}/secret-ledger-{hashlib.sha256(table.encode()).hexdigest()[:24]}"


def scan_with_ledger(spark: SparkSession, docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, blob (hex) and findings, by the ledger at that path, which first gets what it lacks."""
    extend(spark, docs, ledger, text_col)
    both = versions(docs, id_col, text_col).join(entries(spark, ledger), "blob")
    return both.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", F.lower(F.hex("blob")).alias("blob"))


def found_blobs(spark: SparkSession, docs: DataFrame, ledger: str, text_col: str = "text") -> DataFrame:
    """(blob): addresses of docs' texts that hold a secret of any kind, by the ledger."""
    extend(spark, docs, ledger, text_col)
    return entries(spark, ledger).where("spans <> ''").select("blob")


def _oracle() -> str:
    """The same findings in SQL. A match is put between two marks, so that its place follows from the lengths of the pieces."""
    either = lambda words: "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)
    assign = f"({either(('password', 'passwd', 'secret', 'token'))}|[aA][pP][iI]_?[kK][eE][yY])[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+"
    patterns = [assign, *(p.pattern for p in (ACCESS, HEX, PEM, JWT, URLCRED))]
    value = "regexp_extract(hit, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)"
    begin, end = "chr(57344)", "chr(57345)"  # private characters
    kinds = "\n  union all ".join(f"select row_id, {k} as kind, string_split(regexp_replace(text, '{p}', {begin} || '\\0' || {end}, 'g'), {begin}) as pieces from numbered where regexp_matches(text, '{p}')" for k, p in enumerate(patterns))
    names = "['" + "', '".join(KINDS) + "']"
    say = lambda which: f"coalesce(string_agg({names}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind){which}, '')"
    return f"""
with numbered as (select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents),
  marked as (
  {kinds}),
  hits as (
    select row_id, kind, i, split_part(pieces[i], {end}, 1) as hit,
      list_sum(list_transform(pieces[1:i - 1], lambda p: length(p)))::bigint - (i - 2) as start
    from (select *, unnest(range(2, len(pieces) + 1)) as i from marked)),
  spans as (select row_id, kind, start, start + length(hit) as stop from hits where kind <> 0 or length({value}) >= {ASSIGN_LEAST}),
  told as (
    select row_id, count_if(kind = 0)::bigint as n_assign, count_if(kind = 1)::bigint as n_access, count_if(kind = 2)::bigint as n_hex,
      {say(f' filter (kind < {BASE_KINDS})')} as base, {say('')} as spans
    from spans group by row_id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(encode(text)) as blob
from numbered left join told using (row_id)
"""


ORACLE = _oracle()
