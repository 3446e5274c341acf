"""SQL building blocks for comparing the named queries in another engine."""

DOC = """
with files as (
  select doc_id as file_seq, coalesce(source, '') || '/' || doc_id || '.' || coalesce(lang, '') as filename, lang as filetype,
    octet_length(encode(text))::bigint as filesize, source as label, encode(text) as body,
    case when octet_length(encode(text)) <= 0 then 0 else (1::bigint << (length(bin(octet_length(encode(text)))) - 1)) end::bigint as size_class
  from documents where text is not null),
chunks as (
  select file_seq, filename, filetype, filesize, size_class, label, i as chunk_seq, i * 1024 as "offset", sha1(body[i * 1024 + 1:(i + 1) * 1024]) as fp,
    octet_length(body[i * 1024 + 1:(i + 1) * 1024])::bigint as chunksize
  from files, lateral (select unnest(range(0, (filesize - 1) // 1024 + 1)) as i) where filesize > 0),
firsts as (select *, row_number() over (partition by fp order by file_seq, chunk_seq) = 1 as first from chunks)
"""

LI = """
with chunks as (
  select l_orderkey as file_seq, l_linenumber::bigint as chunk_seq, o_orderpriority as filetype, year(o_orderdate)::int as gen, p_size::bigint * 1024 as chunksize, md5(l_partkey::varchar) as fp
  from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
files as (select file_seq, sum(chunksize)::bigint as filesize from chunks group by file_seq),
firsts as (select *, row_number() over (partition by fp order by file_seq, chunk_seq) = 1 as first from chunks)
"""


def internal(base: str, key: str) -> str:
    return f"""{base}
select case when grouping({key}) = 1 then 'ALL' else {key}::varchar end as key, sum(case when first then chunksize else 0 end)::bigint as real, sum(chunksize)::bigint as total,
  case when sum(chunksize) = 0 then 0 else round(100.0 * (1.0 - sum(case when first then chunksize else 0 end)::double / sum(chunksize)), 6) end::double as dedup_pct
from firsts group by grouping sets (({key}), ())
"""


def totals(base: str) -> str:
    return f"""{base}
select f.total_bytes, c.unique_bytes, f.total_bytes - c.unique_bytes as redundant_bytes, round(100.0 * (f.total_bytes - c.unique_bytes) / f.total_bytes, 6)::double as redundancy_pct, c.n_chunks, f.total_bytes // c.n_chunks as mean_chunk
from (select sum(filesize)::bigint as total_bytes from files) f, (select sum(chunksize) filter (first)::bigint as unique_bytes, count(*)::bigint as n_chunks from firsts) c
"""


def temporal(base: str, gen: str, key: str) -> str:
    return f"""{base},
g as (select *, {gen} as g from chunks),
marked as (select *, row_number() over (partition by g, fp order by file_seq, chunk_seq) = 1 and not exists (select 1 from g b where b.g = a.g - 1 and b.fp = a.fp) as new from g a)
select g as gen, case when grouping({key}) = 1 then 'ALL' else {key}::varchar end as key, sum(case when new then chunksize else 0 end)::bigint as real, sum(chunksize)::bigint as total,
  case when sum(chunksize) = 0 then 100 else round(100.0 * sum(case when new then chunksize else 0 end) / sum(chunksize), 6) end::double as patch_pct
from marked group by grouping sets ((g, {key}), (g))
"""


def mib_by(rows: str, key: str) -> str:
    return f"""
select case when grouping({key}) = 1 then 'ALL' else {key}::varchar end as key, round(sum(real) / 1048576.0, 6)::double as real_mib, round(sum(total) / 1048576.0, 6)::double as total_mib
from {rows} group by grouping sets (({key}), ())
"""


def modal(base: str, key: str) -> str:
    return f"""{base},
per as (select fp, {key}, count(*) as n, sum(chunksize) as b from chunks group by fp, {key}),
ranked as (select *, sum(n) over w as nn, sum(b) over w as bb, row_number() over (partition by fp order by n desc, {key}) as r from per window w as (partition by fp)),
one as (select {key}, bb::double / nn as real, bb::double as total from ranked where r = 1)
{mib_by("one", key)}"""


def exact(key: str) -> str:
    return f"""{DOC},
data as (select fp, size_class as filelength, filetype, count(*) as usage_count, max(chunksize) as chunksize from chunks group by all),
shared as (select *, usage_count * (chunksize::double / sum(usage_count) over (partition by fp)) as real, (usage_count * chunksize)::double as total from data)
{mib_by("shared", key)}"""


def percentile(values: str, p: int, order: str) -> str:
    return f"(list({values} order by {order}))[(count(*) * {p} // 100)::int + 1]"


def sampled(base: str, k: int, where: str = "true") -> str:
    """CTEs: sample (fp, base_count, chunk_size) and scan over chunks that where admits."""
    return f"""{base},
pool as (select * from chunks where {where}),
drawn as (select * from pool order by md5('1:' || file_seq || ':' || chunk_seq) limit {k}),
sample as (select fp, count(*) as base_count, min(chunksize) as chunk_size from drawn group by fp)"""


def estimated(key: str | None = None) -> str:
    k = f"{key}, " if key else ""
    return f"""
select {k}n_samples, total_bytes, round(ratio, 6)::double as ratio, round((1.0 - ratio) * total_bytes, 3)::double as real_bytes, round(ratio * total_bytes, 3)::double as redundant_bytes,
  coalesce(ratio > 0 and n_samples >= (ln(2) + ln(10000)) / (2 * 0.0001) / (ratio * ratio), false) as enough
from (
  select {k}coalesce(sum(base_count), 0)::bigint as n_samples, sum(bytes)::bigint as total_bytes,
    case when sum(base_count * chunk_size) > 0 then 1.0 - sum(base_count * chunk_size::double / scan) / sum(base_count * chunk_size::double) end as ratio
  from (select {k}fp, count(*) as scan, sum(chunksize) as bytes from pool group by {k}fp) s left join sample using (fp)
  {"group by " + key if key else ""})
"""
