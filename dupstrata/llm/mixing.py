"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's documents fall into BLOCKS blocks by a hash of the id. A source's target is a share of all words by
weight, filled up to REPEAT times its size: shares are fixed by water-filling (targets are min(REPEAT * size, level *
weight), and the level is found from running sums over the sources in the order in which they reach their limit). A
target buys whole passes over the source and then part of one: blocks in a permuted order, whole until the target is
met; in the block where that happens, documents in a permuted order, the last one up to the word. So a source's taken
words equal its target rounded down.

The blocks so drawn are the source's exact quota. The tree deals quotas out among output shards: its root holds all
quotas, and each node sends a multivariate hypergeometric draw of them to its left child (the blocks' tickets in
permuted order, the first half to the left) and the rest to its right. Leaves are shards, equal to within one block;
their quotas for a source are met by disjoint runs of its permuted blocks. Within a shard, rows are ordered by a hash.

All draws are hashes of ids and a seed, so reruns agree. Sizes are words; null text has size 0. A null source comes
last and is a source of its own. Rows with equal ids are told apart by their size only where both count; repeated rows
are taken alike. Window operators see at most BLOCKS rows of a source or the documents of one block, never a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dupstrata.llm.common import WORD, cut

WEIGHTS, SHARE, REPEAT = (5, 2, 1), 1.5, 2
BLOCKS, LEVELS, SEED = 256, 3, "mix"


def draw(seed: str, *parts: str) -> Column:
    """A number of 60 bits from an MD5 of the seed and these columns as text: the same in any SQL engine."""
    said = F.concat_ws("/", F.lit(seed), *[F.col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 15), 16, 10).cast("long")


def words(text: str | Column) -> Column:
    """The number of words, by a JVM expression: words are what is left between runs of white space."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """source, source_size, target from one row for each source. Windows here run over sources only."""
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(everyone) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight)
    limit = F.lit(float(repeat)) * F.col("source_size")
    filling = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    pool = share * F.sum("source_size").over(whole)
    full = F.coalesce(F.sum(limit).over(before), F.lit(0.0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", (pool - full) / rest).withColumn("limit", limit)
    level = F.max("level").over(whole)  # it rises while sources fill up and falls from the first that does not
    return ranked.select("source", "source_size", F.least(F.col("limit"), level * F.col("weight")).alias("target"))


def tree(tickets: DataFrame, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """tickets: any columns and `ticket`, a key of its own for each drawn block. Adds shard, 0 to 2**levels - 1.

    At each level a node's tickets stand in the order of a hash and the first half goes left, which is a multivariate
    hypergeometric draw of the sources' quotas. Tickets are blocks, BLOCKS times REPEAT for a source at most.
    """
    out = tickets.withColumn("shard", F.lit(0))
    for level in range(levels):
        node = Window.partitionBy("shard")
        place = F.row_number().over(node.orderBy(draw(f"{seed}/{level}", "ticket"), "ticket"))
        out = out.withColumn("_right", (2 * place > F.count(F.lit(1)).over(node) + 1).cast("int"))
        out = out.withColumn("shard", 2 * F.col("shard") + F.col("_right")).drop("_right")
    return out


def plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: str = SEED) -> DataFrame:
    """One row for each (source, block) of sized: its source's size and target, whole passes, and the words that the last pass takes of it.

    sized: source, block, size.
    """
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    by_source = targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, share, repeat)
    both = blocks.withColumnRenamed("source", "own").join(by_source, F.col("own").eqNullSafe(F.col("source"))).drop("own")
    want = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    both = both.withColumn("passes", F.least(passes, F.lit(repeat).cast("long")))
    rest = F.when(F.col("passes") >= repeat, F.lit(0)).otherwise(want - F.col("passes") * F.col("source_size"))
    order = Window.partitionBy("source").orderBy(draw(f"{seed}/blocks", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("block_size").over(order), F.lit(0).cast("long"))
    return both.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("block_size"), rest - start)))


def deal(planned: DataFrame, levels: int = LEVELS, seed: str = SEED) -> DataFrame:
    """(source, block, first_shard, last_shard): where the tree sends a block's whole passes and its last, partial one."""
    drawn = F.sequence(F.lit(1).cast("long"), F.col("passes") + (F.col("part") > 0).cast("long"))
    one = planned.where((F.col("passes") > 0) | (F.col("part") > 0)).select("source", "block", "passes", F.explode(drawn).alias("pass"))
    dealt = tree(one.withColumn("ticket", F.concat_ws("/", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), F.col("block").cast("string"), F.col("pass").cast("string"))), levels, seed)
    return dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("shards"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, levels: int = LEVELS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", blocks: int = BLOCKS, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, source_size, source, target, taken, shards (pass and shard of each copy), place (order within a shard).

    Columns named in keep come along under `kept` (a struct).
    """
    key = F.col(id_col)
    block = F.pmod(draw(f"{seed}/block", "doc_id"), F.lit(blocks)).cast("int")
    extra = [F.struct(*[F.col(f"`{k}`") for k in keep]).alias("kept")] if keep else []
    sized = docs.select(key.cast("long").alias("doc_id"), words(text_col).alias("size"), F.col(source_col).alias("source"), *extra).withColumn("block", block)
    if not keep:
        sized = cut(sized, "mix-sizes")  # three columns of numbers and a name: read again instead of the texts
    planned = cut(plan(sized.select("source", "block", "size"), weights, share, repeat, seed), "mix-plan")
    shards = deal(planned, levels, seed)
    named = lambda df: df.withColumnRenamed("source", "_s").withColumnRenamed("block", "_b")
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))
    known = planned.join(named(shards), same, "left").drop("_s", "_b")
    both = sized.join(named(known), same).drop("_s", "_b")
    place = draw(f"{seed}/docs", "doc_id")
    order = Window.partitionBy("source", "block").orderBy(place, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(order), F.lit(0).cast("long"))
    last = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("part") - start))
    return both.withColumn("last", last).select(
        "doc_id", "size", "source_size", "source", "target", (F.col("passes") * F.col("size") + F.col("last")).alias("taken"), "passes", "last",
        F.coalesce("shards", F.expr("cast(array() as array<struct<pass:bigint,shard:int>>)")).alias("shards"), place.alias("place"), *(["kept"] if keep else []),
    )


def copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy that it takes, with the words taken of it, its shard and place there."""
    one = mixed.withColumn("copy", F.explode("shards"))
    taken = F.when(F.col("copy.pass") <= F.col("passes"), F.col("size")).otherwise(F.col("last"))
    return one.withColumn("words", taken).where(F.col("words") > 0).withColumn("shard", F.col("copy.shard")).withColumn("place", F.xxhash64("place", "copy.pass"))


def _oracle() -> str:
    """The same mix in SQL, for comparison."""
    number = lambda *parts: "('0x' || substr(md5(" + " || '/' || ".join(parts) + "), 1, 15))::bigint"
    levels = "".join(
        f"""
  t{k + 1} as (select * exclude (shard), 2 * shard + (2 * row_number() over (partition by shard order by {number(f"'{SEED}/{k}'", "ticket")}, ticket)
    > count(*) over (partition by shard) + 1)::int as shard from t{k}),"""
        for k in range(LEVELS)
    )
    return f"""
with sized as (
  select doc_id, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size, source,
    {number(f"'{SEED}/block'", "doc_id::varchar")} % {BLOCKS} as block from documents),
  sources as (select source, sum(size)::bigint as source_size from sized group by source),
  weighed as (
    select *, ([{', '.join(f'{w}.0' for w in WEIGHTS)}])[((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)}) + 1]::double as weight, {REPEAT}.0::double * source_size as lim from sources),
  leveled as (
    select *, ({SHARE} * sum(source_size) over () - coalesce(sum(lim) over f, 0))::double / (sum(weight) over () - coalesce(sum(weight) over f, 0)) as level
    from weighed window f as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)),
  targets as (select source, source_size, least(lim, max(level) over () * weight) as target from leveled),
  blocks as (select source, block, sum(size)::bigint as block_size from sized group by source, block),
  asked as (
    select b.*, t.source_size, t.target, floor(t.target)::bigint as want,
      case when source_size > 0 then least({REPEAT}, floor(t.target)::bigint // source_size) else 0 end as passes
    from blocks b join targets t on b.source is not distinct from t.source),
  parts as (
    select *, greatest(0, least(block_size, case when passes >= {REPEAT} then 0 else want - passes * source_size end
      - coalesce(sum(block_size) over (partition by source order by {number(f"'{SEED}/blocks'", "block::varchar")}, block rows between unbounded preceding and 1 preceding), 0)))::bigint as part
    from asked),
  t0 as (
    select source, block, pass, coalesce('s' || source, 'n') || '/' || block || '/' || pass as ticket, 0 as shard
    from (select source, block, unnest(range(1, (passes + (part > 0)::int + 1)::bigint)) as pass from parts)),{levels}
  first as (select source, block, min_by(shard, pass)::int as shard from t{LEVELS} group by source, block),
  placed as (
    select s.*, p.source_size, p.target, p.passes, greatest(0, least(s.size, p.part - coalesce(sum(s.size) over (
      partition by s.source, s.block order by {number(f"'{SEED}/docs'", "doc_id::varchar")}, doc_id, size rows between unbounded preceding and 1 preceding), 0))) as last
    from sized s join parts p on s.source is not distinct from p.source and s.block = p.block)
select d.doc_id, d.size, d.source_size, d.target, (d.passes * d.size + d.last)::bigint as taken, coalesce(f.shard, -1)::int as shard
from placed d left join first f on d.source is not distinct from f.source and d.block = f.block
"""


ORACLE = _oracle()
