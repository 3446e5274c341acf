"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed into multiword Shift-And masks, one bit for each state of each pattern, 64 states to a word. All
patterns advance together over the bytes of a canonical URL (lower-cased host, a border, path), and all URLs of a batch
advance together as rows of a matrix. The border is a byte that no text has, and no `*` runs over it, so a `*` in a
rule's host part stays in the host and one in its path part in the path. After the last byte the final states tell which
rules fit, and the longest rule wins; of rules of one length, the first listed.

A rule such as `example.net/en/` stands for two globs, its host itself and its subdomains, each with anything after the
path. Where no listed rule fits, the method's own globs decide; without any, the verdict is allow. A null URL or one
without `://` has empty host and path, no rule, and is allowed. Repeated ids stay repeated rows; an empty table gives an
empty result. Very long URLs are read to their end, one byte of a batch's longest at a time. Only the id and the URL
column are read, so further columns of any name (host, rule, ...) do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The listed rules, and globs (host, path) of the method for hosts that no listed rule covers.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
GLOBS = (("*pills*", "*", "block"), ("*casino*", "*", "block"), ("*", "*/wp-login*", "block"), ("*", "*.exe", "block"))


#: Stands between host and path; no byte of UTF-8.
BORDER = 0xFF


@dataclass(frozen=True)
class Glob:
    host: str
    path: str
    rule: int  # index of what it stands for


class ShiftAnd:
    """One bit for each literal byte of each pattern and one before it; a `*` is a loop on the state before it."""

    def __init__(self, globs: Sequence[Glob]):
        states: list[tuple[int, bool]] = []  # byte that leads into the state (-1: start), and whether it loops
        self.final: list[tuple[int, int]] = []
        for g in globs:
            states.append((-1, False))
            for b in (*(-42 if b == 42 else b for b in g.host.encode()), BORDER, *(-42 if b == 42 else b for b in g.path.encode())):
                if b == -42:
                    states[-1] = (states[-1][0], True)
                else:
                    states.append((b, False))
            self.final.append((len(states) - 1, g.rule))
        words = max(1, -(-len(states) // 64))
        bit = lambda i: (i // 64, np.uint64(1 << (i % 64)))
        self.first = np.zeros(words, np.uint64)
        self.step = np.zeros((256, words), np.uint64)
        self.loop = np.zeros((256, words), np.uint64)
        for i, (b, loop) in enumerate(states):
            w, m = bit(i)
            if b < 0:
                self.first[w] |= m
            else:
                self.step[b, w] |= m
            if loop:
                self.loop[:, w] |= m
                self.loop[BORDER, w] &= ~m
        self.ends = [(*bit(i), r) for i, r in self.final]

    def run(self, urls: Sequence[bytes]) -> np.ndarray:
        """A row for each URL, a column for each pattern: whether it fits the whole URL."""
        order = sorted(range(len(urls)), key=lambda i: -len(urls[i]))
        at = np.repeat(self.first[None, :], len(urls), 0)
        lengths = np.array([len(urls[i]) for i in order])
        longest = int(lengths[0]) if len(urls) else 0
        live = len(urls)
        for p in range(longest):
            while live and lengths[live - 1] <= p:
                live -= 1
            b = np.fromiter((urls[i][p] for i in order[:live]), np.uint8, live)
            now = at[:live]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            at[:live] = (moved & self.step[b]) | (now & self.loop[b])
        out = np.zeros((len(urls), len(self.ends)), bool)
        for k, (w, m, _) in enumerate(self.ends):
            out[order, k] = (at[:, w] & m) != 0
        return out


def canonical(host: str, path: str) -> bytes:
    """What the automaton reads."""
    return host.encode("utf-8", "surrogatepass") + bytes([BORDER]) + path.encode("utf-8", "surrogatepass")


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path of a URL column, by JVM expressions."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, globs: Sequence[tuple[str, str, str]] = GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row."""
    packed: list[Glob] = []
    for i, (rule, _) in enumerate(rules):
        host, slash, path = rule.partition("/")
        packed += [Glob(host, f"{slash}{path}*", i), Glob(f"*.{host}", f"{slash}{path}*", i)]
    packed += [Glob(host, path, len(rules) + k) for k, (host, path, _) in enumerate(globs)]
    automaton = ShiftAnd(packed)
    of = np.array([g.rule for g in packed])
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i][0]), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = [canonical(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            fits = automaton.run(urls)
            said: list[str | None] = [None] * len(urls)
            verdict = np.full(len(urls), "", object)
            for i in reversed(rank):
                for k in np.flatnonzero(fits[:, of == i].any(1)):
                    said[k], verdict[k] = rules[i]
            for g in range(len(globs)):
                verdict[(verdict == "") & fits[:, of == len(rules) + g].any(1)] = globs[g][2]
            verdict[verdict == ""] = "allow"
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(said, pa.string()), pa.array(list(verdict), pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = parts(url_col)
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return df.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def _oracle() -> str:
    like = lambda g: g.replace("_", "\\_").replace("%", "\\%").replace("*", "%")
    fits = lambda r: f"((host = '{r.partition('/')[0]}' or host like '%.{r.partition('/')[0]}') and starts_with(path, '/{r.partition('/')[2]}'))"
    by_length = sorted(RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"when {fits(r)} then '{r}'" for r, _ in by_length)
    verdict = " ".join(f"when {fits(r)} then '{v}'" for r, v in by_length)
    more = " ".join(f"when host like '{like(h)}' escape '\\' and path like '{like(p)}' escape '\\' then '{v}'" for h, p, v in GLOBS)
    return f"""
with rest as (select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as r from pages),
  hosts as (select page_id, r, regexp_extract(r, '^[^/?#]*') as h from rest),
  cut as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(r, length(h) + 1), '^[^?#]*') as path from hosts)
select page_id, host, path, case {rule} end as rule, case {verdict} {more} else 'allow' end as verdict from cut
"""


ORACLE = _oracle()
