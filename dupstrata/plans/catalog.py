"""Named queries over the driver's tables, each with its SQL where SQL can say it.

Documents stand for files cut into 1 KiB chunks; orders stand for files whose chunks are their lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupstrata.functions import scalars as S
from dupstrata.operators import harnik, reassemble, redundancy, statistics
from dupstrata.operators.chunking import Digest, chunk_files, fixed_chunks
from dupstrata.plans import sql as Q
from dupstrata.sources import delimited
from dupstrata.sources.tables import document_chunks, document_files, order_chunks, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def doc_files(spark: SparkSession, d: str) -> DataFrame:
    return document_files(spark, d).drop("body").withColumn("size_class", S.size_class("filesize"))


# Chunking and fingerprints.


@query(Q.DOC + 'select file_seq, chunk_seq, "offset", chunksize, fp from chunks')
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return document_chunks(spark, d).select("file_seq", "chunk_seq", "offset", "chunksize", "fp")


@query("select doc_id, sha1(encode(text)) as fp from documents where text is not null")
def fingerprint_sha1(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text is not null").select("doc_id", Digest().column(F.col("text").cast("binary")).alias("fp"))


@query("select doc_id, md5(encode(text)) as fp from documents where text is not null")
def fingerprint_md5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text is not null").select("doc_id", Digest("MD5").column(F.col("text").cast("binary")).alias("fp"))


@query("select doc_id, substr(sha256(encode(text || 'pepper')), 1, 20) as fp from documents where text is not null")
def fingerprint_sha256_trunc_salt(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("text is not null").select("doc_id", Digest("SHA-256", 10, b"pepper").column(F.col("text").cast("binary")).alias("fp"))


CHUNK_INVARIANTS = """
with cut as (select doc_id as file_seq, octet_length(encode(text))::bigint as filesize from documents where text is not null and text <> ''),
kinds as (select unnest([{names}]) as chunker)
select file_seq, chunker, filesize, filesize as chunk_bytes, true as contiguous, true as within from cut, kinds
"""


def _invariants(chunks: DataFrame, least: dict[str, int], most: dict[str, int]) -> DataFrame:
    end = F.max("chunk_seq")
    pick = lambda sizes: F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("chunker"))
    inner = chunks.withColumn("_least", pick(least)).withColumn("_most", pick(most))
    got = inner.groupBy("file_seq", "chunker", "filesize").agg(
        F.sum("chunksize").alias("chunk_bytes"), F.max(F.struct("chunk_seq", "chunksize")).alias("_last"), end.alias("_end"), F.count(F.lit(1)).alias("_n"), F.max(F.col("offset") + F.col("chunksize")).alias("_to"),
        F.min("offset").alias("_from"), F.count_if(F.col("chunksize") < F.col("_least")).alias("_short"), F.count_if((F.col("chunksize") > F.col("_most")) | (F.col("chunksize") < 1)).alias("_bad"), F.first("_least").alias("_l"),
    )
    contiguous = (F.col("_from") == 0) & (F.col("_to") == F.col("chunk_bytes")) & (F.col("_n") == F.col("_end") + 1)
    within = (F.col("_bad") == 0) & (F.col("_short") == F.when(F.col("_last.chunksize") < F.col("_l"), 1).otherwise(0))
    return got.select("file_seq", "chunker", "filesize", "chunk_bytes", contiguous.alias("contiguous"), within.alias("within"))


@query(CHUNK_INVARIANTS.format(names="'cdc2'"))
def cdc_invariants(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_files(document_files(spark, d), "body", ("file_seq", "filesize"), ("cdc2",))
    return _invariants(c, {"cdc2": 512 - 47}, {"cdc2": 8192})


@query(CHUNK_INVARIANTS.format(names="'cdc2', 'cdc8', 'fixed4'"))
def cdc_multi_chunker(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_files(document_files(spark, d), "body", ("file_seq", "filesize"), ("cdc2", "cdc8", "fixed4"))
    return _invariants(c, {"cdc2": 465, "cdc8": 2001, "fixed4": 4096}, {"cdc2": 8192, "cdc8": 32768, "fixed4": 4096})


@query()
def cdc_dedup(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.internal(chunk_files(document_files(spark, d), "body", ("file_seq", "filetype", "filesize"), ("cdc2",)), "filetype")


# Scalar functions.

_TYPE = """
with base as (select page_id, url, regexp_extract(url, '[^/]*$') as b from pages),
suffix as (select page_id, url, case when contains(b, '.') then regexp_extract(b, '[^.]*$') else '' end as s, contains(b, '.') as has from base),
typed as (select page_id, url, case when not has or length(s) > 5 then '---' else s end as filetype from suffix)
"""


@query(_TYPE + "select page_id, filetype, case when n = '' then '---' else n end as normalized from (select page_id, filetype, regexp_replace(replace(lower(filetype), ':', '-'), '~$', '') as n from typed)")
def filetype_norm(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", S.file_type("url").alias("filetype"), S.normalized_file_type("url").alias("normalized"))


@query("select l_orderkey, l_linenumber, n, case when n <= 0 then 0 else (1::bigint << (length(bin(n)) - 1)) end::bigint as size_class from (select l_orderkey, l_linenumber, floor(l_extendedprice)::bigint as n from lineitem)")
def size_class(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("long").alias("n"))
    return t.withColumn("size_class", S.size_class("n"))


@query("select o_orderkey, n, case when n > 1073741824 then printf('%.2fG', round(n / 1073741824.0::double, 2)) when n > 1048576 then printf('%.2fM', round(n / 1048576.0::double, 2)) when n > 1024 then printf('%.2fK', round(n / 1024.0::double, 2)) else n::varchar end as text from (select o_orderkey, (floor(o_totalprice) * (o_orderkey % 9) * (o_orderkey % 7))::bigint as n from orders)")
def storage_unit(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select("o_orderkey", (F.floor("o_totalprice") * (F.col("o_orderkey") % 9) * (F.col("o_orderkey") % 7)).cast("long").alias("n"))
    return t.withColumn("text", S.storage_unit("n"))


@query("select p_partkey, said, (p_size * power(1024, i))::bigint as n from (select p_partkey, p_size, (p_partkey % 5)::int as i, p_size || ['', 'k', 'M', 'g', 'T'][(p_partkey % 5)::int + 1] as said from part)")
def storage_unit_parse(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "k", "M", "g", "T")]), (F.col("p_partkey") % 5).cast("int") + 1)
    t = read(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("said"))
    return t.withColumn("n", S.parse_storage_unit("said"))


@query("select page_id, sha1(url) as name from pages")
def privacy_flat_sha1(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", S.private_name("url", "flat-sha1").alias("name"))


@query("select page_id, array_to_string(list_transform(string_split(regexp_replace(url, '/+$', ''), '/'), lambda p: sha1(p)), '/') as name from pages")
def privacy_directory_sha1(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", S.private_name("url", "directory-sha1").alias("name"))


@query("select page_id, list_reduce(list_prepend(0::bigint, list_transform(string_split(url, ''), lambda c: unicode(c)::bigint)), lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648)::varchar as name from pages")
def privacy_flat_default(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", S.private_name("url", "flat-default").alias("name"))


@query(Q.DOC + "select file_seq, chunk_seq, base64(unhex(fp)) as fp64, fp as back from chunks")
def base64_fp(spark: SparkSession, d: str) -> DataFrame:
    c = document_chunks(spark, d).select("file_seq", "chunk_seq", F.base64(F.unhex("fp")).alias("fp64"))
    return c.withColumn("back", S.hex_digest(F.unbase64("fp64")))


# Redundancy.


@query(Q.totals(Q.DOC))
def simple_total(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.simple_totals(doc_files(spark, d), document_chunks(spark, d))


@query(Q.DOC + """,
per as (select file_seq, sum(chunksize)::bigint as b, coalesce(sum(chunksize) filter (first), 0)::bigint as n from firsts group by file_seq)
select f.file_seq, f.filesize, coalesce(b, 0)::bigint as chunk_bytes, (f.filesize - coalesce(n, 0))::bigint as redundancy, case when coalesce(b, 0) = 0 then 0 else round(100.0 * (f.filesize - n) / b, 6) end::double as redundancy_pct,
  (coalesce(b, 0) - (f.filesize - coalesce(n, 0)))::bigint as patch, false as illegal from files f left join per using (file_seq)""")
def simple_per_file(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.simple_per_file(doc_files(spark, d), document_chunks(spark, d))


@query(Q.internal(Q.DOC, "filetype"))
def ir_by_type(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.internal(document_chunks(spark, d), "filetype")


@query(Q.internal(Q.DOC, "size_class"))
def ir_by_size(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.internal(document_chunks(spark, d), "size_class")


@query(Q.internal(Q.LI, "filetype"))
def ir_orders(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.internal(order_chunks(spark, d), "filetype")


def _gens(spark: SparkSession, d: str) -> DataFrame:
    return document_chunks(spark, d).withColumn("gen", (F.col("file_seq") % 2).cast("long"))


@query("select gen, real, total, patch_pct from (" + Q.temporal(Q.DOC, "(file_seq % 2)::bigint", "filetype") + ") where key = 'ALL' and gen = 1")
def tr_total(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.temporal(_gens(spark, d), "filetype").where("key = 'ALL' and gen = 1").select("gen", "real", "total", "patch_pct")


@query(Q.temporal(Q.DOC, "(file_seq % 2)::bigint", "filetype"))
def tr_by_type(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.temporal(_gens(spark, d), "filetype")


@query(Q.temporal(Q.LI, "gen::bigint", "filetype"))
def tr_generations(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.temporal(order_chunks(spark, d).withColumn("gen", F.col("gen").cast("long")), "filetype")


@query(Q.DOC + "select distinct fp from chunks")
def distinct_fps(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.distinct_fingerprints(document_chunks(spark, d))


@query(Q.DOC + "select file_seq, chunk_seq, fp from chunks a where file_seq % 2 = 1 and not exists (select 1 from chunks b where b.file_seq % 2 = 0 and b.fp = a.fp)")
def unseen_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _gens(spark, d)
    return redundancy.unseen(c.where("gen = 1"), c.where("gen = 0")).select("file_seq", "chunk_seq", "fp")


_PRINT = ", marks as (select file_seq, md5(unhex(string_agg(fp, '' order by chunk_seq))) as fingerprint from chunks group by file_seq)"


@query(Q.DOC + _PRINT + "select file_seq, fingerprint from marks")
def file_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.file_fingerprints(document_chunks(spark, d))


@query(Q.DOC + _PRINT + """, dup as (select filesize, row_number() over (partition by coalesce(fingerprint, '') order by file_seq) > 1 as again from files left join marks using (file_seq))
select count(*)::bigint as n_files, sum(filesize)::bigint as total_bytes, count_if(again)::bigint as duplicate_files, coalesce(sum(filesize) filter (again), 0)::bigint as duplicate_bytes, round(100.0 * coalesce(sum(filesize) filter (again), 0) / sum(filesize), 6)::double as duplicate_pct from dup""")
def full_file(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.full_file(doc_files(spark, d), document_chunks(spark, d))


_ZERO = """
with bodies as (select p_partkey as file_seq, p_size as n, p_partkey % 3 = 0 as zero from part),
chunks as (select file_seq, zero, case when zero then sha1(encode(repeat(chr(120), 1024))) else md5(p::varchar) end as fp, 1024::bigint as chunksize from (select *, unnest(range(0, n)) as p from bodies))
select sum(chunksize)::bigint as total_bytes, count(*)::bigint as n_chunks, sum(case when zero then chunksize else 0 end)::bigint as zero_bytes, count_if(zero)::bigint as n_zero, round(100.0 * sum(case when zero then chunksize else 0 end) / sum(chunksize), 6)::double as zero_pct from chunks
"""


@query(_ZERO)
def zero_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Every third part is a run of one repeated block, which plays the zero chunk; its digest is derived, not looked up."""
    filler = Digest().of(b"x" * 1024)
    t = read(spark, d, "part").select(F.col("p_partkey").alias("file_seq"), (F.col("p_partkey") % 3 == 0).alias("zero"), F.explode(F.sequence(F.lit(1), F.col("p_size"))).alias("p"))
    c = t.select(F.when(F.col("zero"), F.lit(filler)).otherwise(F.md5(F.concat_ws("/", F.lit("p"), F.col("p").cast("string")).cast("binary"))).alias("fp"), F.lit(1024).cast("long").alias("chunksize"))
    return redundancy.zero_chunks(c, [filler])


# Statistics.

_PCT = ", ".join(f"{Q.percentile('filesize', p, 'filesize, file_seq')} as p{p}" for p in statistics.PERCENTILES) + ", " + ", ".join(f"{Q.percentile('c', p, 'filesize, file_seq')}::bigint as c{p}" for p in statistics.PERCENTILES)


@query(Q.DOC + f", run as (select *, sum(filesize) over (order by filesize, file_seq) as c from files) select count(*)::bigint as n, sum(filesize)::bigint as total, (sum(filesize) // count(*))::bigint as mean, max(filesize) as largest, {_PCT} from run")
def file_stats(spark: SparkSession, d: str) -> DataFrame:
    return statistics.file_statistics(doc_files(spark, d))


def _details(key: str) -> str:
    return Q.DOC + f""", run as (select *, sum(filesize) over (partition by {key} order by filesize, file_seq) as c from files)
select {key}::varchar as key, count(*)::bigint as n, sum(filesize)::bigint as total, (sum(filesize) // count(*))::bigint as mean, max(filesize) as largest, {Q.percentile('filesize', 50, 'filesize, file_seq')} as median, {Q.percentile('c', 50, 'filesize, file_seq')}::bigint as cumulative_median from run group by {key}"""


@query(_details("filetype"))
def file_details_type(spark: SparkSession, d: str) -> DataFrame:
    return statistics.file_details(doc_files(spark, d), "filetype")


@query(_details("size_class"))
def file_details_size(spark: SparkSession, d: str) -> DataFrame:
    return statistics.file_details(doc_files(spark, d), "size_class")


@query(Q.DOC + "select chunksize, count(*)::bigint as n, count_if(filesize > 1048576)::bigint as n_large from chunks group by chunksize")
def chunk_size_dist(spark: SparkSession, d: str) -> DataFrame:
    return statistics.chunk_sizes(document_chunks(spark, d))


@query(Q.DOC + "select (select sum(filesize)::bigint from files) as file_bytes, (select count(*)::bigint from files) as n_files, (select count(*)::bigint from chunks) as n_chunks")
def validate(spark: SparkSession, d: str) -> DataFrame:
    return statistics.validate(doc_files(spark, d), document_chunks(spark, d))


@query(Q.DOC + 'select file_seq, chunk_seq, fp, "offset" as begin, chunksize from chunks')
def view_offsets(spark: SparkSession, d: str) -> DataFrame:
    return statistics.with_offsets(document_chunks(spark, d).drop("offset")).select("file_seq", "chunk_seq", "fp", "begin", "chunksize")


@query(Q.DOC + "select filetype::varchar as key, sum(filesize)::bigint as total, count(*)::bigint as n from files group by filetype")
def filestats_type(spark: SparkSession, d: str) -> DataFrame:
    return statistics.file_totals(doc_files(spark, d), "filetype")


@query(Q.DOC + "select size_class::varchar as key, sum(filesize)::bigint as total, count(*)::bigint as n from files group by size_class")
def filestats_size(spark: SparkSession, d: str) -> DataFrame:
    return statistics.file_totals(doc_files(spark, d), "size_class")


@query(Q.DOC + ", per as (select file_seq, sum(chunksize)::bigint as b from chunks group by file_seq) select filetype::varchar as key, sum(filesize)::bigint as stat_bytes, sum(b)::bigint as chunk_bytes, count(*)::bigint as n from files join per using (file_seq) group by filetype")
def filestats_chunked(spark: SparkSession, d: str) -> DataFrame:
    return statistics.chunked_totals(doc_files(spark, d), document_chunks(spark, d), "filetype")


@query(Q.DOC + """, placed as (select file_seq, fp, lead(fp) over w as nxt, row_number() over w - 1 as i from chunks window w as (partition by file_seq order by chunk_seq))
select file_seq, (i // 2)::bigint as pair_seq, case when nxt is null then fp else md5(unhex(fp || nxt)) end as fp from placed where i % 2 = 0""")
def combine_chunks(spark: SparkSession, d: str) -> DataFrame:
    return statistics.combine_chunks(document_chunks(spark, d))


@query("select user_id, event_id, value, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6)::double as moving from events")
def sliding_average(spark: SparkSession, d: str) -> DataFrame:
    return statistics.sliding_average(read(spark, d, "events"), "value", ["user_id"], ["ts", "event_id"], 4).select("user_id", "event_id", "value", "moving")


# Attribution by reference counts.


@query(Q.LI + ", per as (select fp, count(*) as n, avg(chunksize) as s from chunks group by fp) select round(sum(s) / 1048576.0, 6)::double as real_mib, round(sum(n * s) / 1048576.0, 6)::double as total_mib, count(*)::bigint as n_fps from per")
def ir_fast(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.fast_totals(order_chunks(spark, d))


@query(Q.modal(Q.DOC, "filetype"))
def ir_mode_type(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.mode_attributed(document_chunks(spark, d), "filetype")


@query(Q.modal(Q.DOC, "size_class"))
def ir_mode_size(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.mode_attributed(document_chunks(spark, d), "size_class")


@query(Q.DOC + "select fp, size_class as filelength, filetype, count(*)::bigint as usage_count, max(chunksize) as chunksize from chunks group by all")
def chunkdata(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.chunk_data(document_chunks(spark, d))


@query(Q.exact("filetype"))
def exact_ir_type(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.exact_attributed(redundancy.chunk_data(document_chunks(spark, d)), "filetype")


@query(Q.exact("filelength"))
def exact_ir_size(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.exact_attributed(redundancy.chunk_data(document_chunks(spark, d)), "filelength")


@query("select real_mib, total_mib from (" + Q.exact("filetype") + ") where key = 'ALL'")
def exact_ir_all(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.exact_attributed(redundancy.chunk_data(document_chunks(spark, d)), "filetype").where("key = 'ALL'").select("real_mib", "total_mib")


@query(Q.DOC + ", per as (select fp, count(*) as n, max(chunksize) as s from chunks group by fp) select round(sum(s) / 1048576.0, 6)::double as real_mib, round(sum(n * s) / 1048576.0, 6)::double as total_mib, count(*)::bigint as n_fps from per")
def union_fast_ir(spark: SparkSession, d: str) -> DataFrame:
    """Eight prepared runs (documents by id) united again."""
    data = document_chunks(spark, d).withColumn("run", F.col("file_seq") % 8)
    return redundancy.union_fast([redundancy.chunk_data(data.where(F.col("run") == r)) for r in range(8)])


def _whole(key: str) -> str:
    return Q.DOC + _PRINT + f""", per as (select fingerprint as fp, {key}, count(*) as n, sum(filesize) as b from files join marks using (file_seq) group by all),
ranked as (select *, sum(n) over w as nn, sum(b) over w as bb, row_number() over (partition by fp order by n desc, {key}) as r from per window w as (partition by fp)),
one as (select {key}, bb::double / nn as real, bb::double as total from ranked where r = 1)""" + Q.mib_by("one", key)


@query(_whole("filetype"))
def file_redundancy_type(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.file_redundancy(doc_files(spark, d), redundancy.file_fingerprints(document_chunks(spark, d)), "filetype")


@query(_whole("size_class"))
def file_redundancy_size(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.file_redundancy(doc_files(spark, d), redundancy.file_fingerprints(document_chunks(spark, d)), "size_class")


def _pig(key: str) -> str:
    return Q.DOC + f""", per as (select fp, {key}, count(*) as n, sum(chunksize) as b from chunks where file_seq % 2 = 1 group by all),
ranked as (select *, sum(n) over w as nn, sum(b) over w as bb, row_number() over (partition by fp order by n desc, {key}) as r from per window w as (partition by fp)),
one as (select {key}, bb::double as total, case when exists (select 1 from chunks c where c.file_seq % 2 = 0 and c.fp = ranked.fp) then 0 else bb::double / nn end as real from ranked where r = 1)""" + Q.mib_by("one", key)


@query(_pig("filetype"))
def tr_pig_type(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.temporal_modal(_gens(spark, d), "filetype", 0, 1)


@query(_pig("size_class"))
def tr_pig_size(spark: SparkSession, d: str) -> DataFrame:
    return redundancy.temporal_modal(_gens(spark, d), "size_class", 0, 1)


# Sampling.

K = 500


@query(Q.DOC + f"select file_seq, chunk_seq, fp, chunksize from chunks order by md5('1:' || file_seq || ':' || chunk_seq) limit {K}")
def sample_reservoir(spark: SparkSession, d: str) -> DataFrame:
    return harnik.draw(document_chunks(spark, d), K).select("file_seq", "chunk_seq", "fp", "chunksize")


@query(Q.sampled(Q.LI, harnik.SAMPLE) + Q.estimated())
def harnik_total(spark: SparkSession, d: str) -> DataFrame:
    c = order_chunks(spark, d)
    return harnik.estimate(harnik.compact(harnik.draw(c, harnik.SAMPLE)), c)


@query(Q.sampled(Q.LI, harnik.SAMPLE_WITH_BREAKDOWN) + Q.estimated("filetype"))
def harnik_by_type(spark: SparkSession, d: str) -> DataFrame:
    c = order_chunks(spark, d)
    return harnik.estimate(harnik.compact(harnik.draw(c, harnik.SAMPLE_WITH_BREAKDOWN)), c, "filetype")


@query(Q.sampled(Q.DOC, harnik.SAMPLE_WITH_BREAKDOWN) + Q.estimated("size_class"))
def harnik_by_size(spark: SparkSession, d: str) -> DataFrame:
    c = document_chunks(spark, d)
    return harnik.estimate(harnik.compact(harnik.draw(c, harnik.SAMPLE_WITH_BREAKDOWN)), c, "size_class")


@query(f"""with a as ({Q.sampled(Q.DOC, harnik.SAMPLE)} {Q.estimated()}), b as ({Q.sampled(Q.DOC, harnik.SAMPLE, "file_seq % 2 = 0")} {Q.estimated()})
select a.ratio as ratio_all, b.ratio as ratio_first, round((a.ratio * a.total_bytes - b.ratio * b.total_bytes) / (a.total_bytes - b.total_bytes), 6)::double as ratio_second from a, b""")
def harnik_temporal(spark: SparkSession, d: str) -> DataFrame:
    c = _gens(spark, d)
    return harnik.estimate_temporal(c, c.where("gen = 0"), harnik.SAMPLE)


# Traces and text formats.


@query("""with records as (select o_custkey as filename, o_orderkey as record_seq, o_orderkey % 3 <> 0 as partial from orders)
select filename, record_seq, partial, (select min(b.record_seq) from records b where b.filename = a.filename and not b.partial and b.record_seq >= a.record_seq) as file_seq from records a""")
def reassemble_parts(spark: SparkSession, d: str) -> DataFrame:
    r = read(spark, d, "orders").select(F.col("o_custkey").alias("filename"), F.col("o_orderkey").alias("record_seq"), (F.col("o_orderkey") % 3 != 0).alias("partial"))
    return reassemble.assign_parts(r).select("filename", "record_seq", "partial", "file_seq")


@query(Q.DOC + """select '"' || filename || '"|"' || base64(unhex(fp)) || '"|' || chunksize as value from chunks""")
def gp_export_lines(spark: SparkSession, d: str) -> DataFrame:
    return delimited.database_chunk_lines(document_chunks(spark, d))


@query(Q.DOC + """select '"' || filename || '"|' || filesize || '|"' || coalesce(filetype, '') || '"|"' || coalesce(label, '') || '"' as value from files""")
def gp_export_files(spark: SparkSession, d: str) -> DataFrame:
    return delimited.database_file_lines(doc_files(spark, d))


@query("select * from (select '\"' || key || '\";' || real || ';' || total as value from (" + Q.internal(Q.DOC, "filetype") + "))")
def ir_csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return delimited.breakdown_lines(ir_by_type(spark, d))


@query("select row_number() over (order by key = 'ALL', try_cast(key as bigint) nulls last, key)::int as line, value from (select key, '\"' || key || '\";' || real || ';' || total as value from (" + Q.internal(Q.DOC, "size_class") + "))")
def ir_report_size(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the size report with their places: classes ascending, ALL last. There are as many as size classes."""
    from pyspark.sql import Window

    rows = redundancy.internal(document_chunks(spark, d), "size_class")
    place = F.row_number().over(Window.orderBy(F.col("key") == redundancy.ALL, F.expr("try_cast(key as bigint)").asc_nulls_last(), "key"))
    return rows.withColumn("line", place).select("line", F.concat_ws(";", F.concat(F.lit('"'), F.col("key"), F.lit('"')), F.col("real").cast("string"), F.col("total").cast("string")).alias("value"))


@query("select case when contains(url, '=') then regexp_extract(url, '^(.*)=([^=]*)$', 1) else url end as path, case when contains(url, '=') then regexp_extract(url, '^(.*)=([^=]*)$', 2) else 'none' end as label from pages")
def listing_parse(spark: SparkSession, d: str) -> DataFrame:
    return delimited.parse_listing(read(spark, d, "pages"), "url", "none")


@query(Q.DOC + "select count(*)::bigint as n_chunks, sum(chunksize)::bigint as n_bytes, count(distinct fp)::bigint as n_fps, count(distinct file_seq)::bigint as n_files from chunks")
def trace_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as protobuf records and decoded again, inside each task."""
    import io

    import pyarrow as pa

    from dupstrata.sources import wire

    c = document_chunks(spark, d).groupBy("file_seq", "filename", "filesize", "filetype").agg(F.array_sort(F.collect_list(F.struct("chunk_seq", "chunksize", "fp"))).alias("chunks"))

    def run(batches):
        for b in batches:
            f = io.BytesIO()
            names, sizes, types, rows = (b.column(k).to_pylist() for k in ("filename", "filesize", "filetype", "chunks"))
            wire.write_protobuf(f, (wire.Record(n, s, t or "", None, False, [wire.Chunk(x["chunksize"], bytes.fromhex(x["fp"])) for x in r]) for n, s, t, r in zip(names, sizes, types, rows, strict=True)))
            f.seek(0)
            got = [(r.filename, x.size, x.fp.hex()) for r in wire.read_protobuf(f, "FAILFAST") for x in r.chunks]
            yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["filename", "chunksize", "fp"])

    back = c.mapInArrow(run, "filename string, chunksize long, fp string")
    per = back.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.sum("chunksize").alias("b"))
    return per.agg(F.sum("n").alias("n_chunks"), F.sum("b").alias("n_bytes"), F.count(F.lit(1)).alias("n_fps")).crossJoin(back.select("filename").distinct().agg(F.count(F.lit(1)).alias("n_files")))
