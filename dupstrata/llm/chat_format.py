"""Chat formatting by multi-party perspective rotation.

For every participant (distinct role) of a conversation the whole dialogue is rendered with that speaker as assistant
and everyone else as a named user; the mask covers what the assistant says, and nothing else. A turn renders as

    <|assistant|>\\ntext<|end|>\\n            for the chosen speaker
    <|user:NAME|>\\ntext<|end|>\\n            for another one
    <|system|>\\ntext<|end|>\\n               for the role `system`, which is never rotated

and its mask is the text with <|end|> where the assistant speaks. In texts and names, `<|` is written `<\\|` and `|>` is written
`|\\>`, so nothing that is said can be read as a marker. Turns stand in the order of turn (null last), then
role and text, so ties and repeated rows have a defined place: equal rows render as often as they stand in the table.
A null text counts as empty; a null or empty role is the name `unknown`, and so one speaker with a role of that name. A conversation in which only `system` speaks
has no participant and so no rotation. A null conv_id is a conversation of its own. An empty table gives an empty result.
Very long texts are rows like others. Only conv_id, turn, role and text are read, so further columns of any name do no harm.

Turns stay rows, and texts move once, by conversation and range of SPAN turn numbers, so a conversation that holds a third of
all rows is spread over as many tasks as it has ranges. Where a range begins comes from sums over the ranges before it: a
dialogue rendered with all speakers as users, longer or shorter by one head for each earlier turn of the speaker. Within a
range offsets are running sums over sorted, spillable windows. Rows with one turn number (or none) are one range, however
many they are. A digest is a sum of hashes of (offset, rendered turn).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM, ASSISTANT, END = "system", "<|assistant|>\n", "<|end|>\n"
UNNAMED = "unknown"

#: Turn numbers in a range.
SPAN = 256


def escaped(said: Column) -> Column:
    """Without markers."""
    return F.replace(F.replace(said, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def turns(conversations: DataFrame) -> DataFrame:
    role = escaped(F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(UNNAMED)))
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), escaped(F.coalesce("text", F.lit(""))).alias("text"))


def _head(role: str, speaker: Column | None = None) -> Column:
    other = F.when(F.col(role) == SYSTEM, F.lit("<|system|>\n")).otherwise(F.concat(F.lit("<|user:"), F.col(role), F.lit("|>\n")))
    return other if speaker is None else F.when(F.col(role) == speaker, F.lit(ASSISTANT)).otherwise(other)


def range_begins(said: DataFrame) -> DataFrame:
    """key, range, speaker, range_begin: where each range begins in each rotation. Aggregated before the shuffle; numbers only."""
    size = F.length(_head("role")) + F.length("text") + F.lit(len(END))
    sums = said.groupBy("key", "range", "role").agg(F.sum(size.cast("long")).alias("size"), F.count(F.lit(1)).alias("n")).repartition("key")
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.groupBy("key", "range").agg(F.sum("size").alias("size"))
    ranges = ranges.select("key", "range", F.coalesce(F.sum("size").over(earlier.partitionBy("key")), F.lit(0)).alias("base"))
    speakers = sums.where(F.col("role") != SYSTEM).select("key", F.col("role").alias("speaker")).distinct()
    own = sums.select("key", "range", F.col("role").alias("speaker"), "n")
    grid = ranges.join(speakers, "key").join(own, ["key", "range", "speaker"], "left")
    before = F.coalesce(F.sum("n").over(earlier.partitionBy("key", "speaker")), F.lit(0))
    return grid.select("key", "range", "speaker", (F.col("base") + before * (F.lit(len(ASSISTANT)) - F.length(_head("speaker")))).alias("range_begin"))


def rotate(conversations: DataFrame, span: int = SPAN) -> DataFrame:
    """conv_id, speaker, turn, role, rendered, begin, mask_begin, mask_end: one row for each perspective and turn.

    begin is the place of the rendered turn in the rendered dialogue; the mask's ends are null for other speakers.
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    said = turns(conversations).withColumns({"key": key, "range": F.coalesce(F.floor(F.col("turn") / span), F.lit((1 << 63) - 1))})
    both = said.repartition("key", "range").join(range_begins(said), ["key", "range"])
    both = both.withColumn("head", _head("role", F.col("speaker"))).withColumn("rendered", F.concat("head", "text", F.lit(END)))
    order = Window.partitionBy("key", "range", "speaker").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    size = F.length("rendered").cast("long")
    within = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    both = both.withColumn("begin", F.col("range_begin") + within)
    own = F.col("role") == F.col("speaker")
    mask_begin = F.when(own, F.col("begin") + F.length("head"))
    mask_end = F.when(own, F.col("begin") + size - 1)
    return both.select("conv_id", "speaker", "turn", "role", "rendered", "begin", mask_begin.alias("mask_begin"), mask_end.alias("mask_end"))


def part(value: Column) -> Column:
    """48 bits of an MD5, as a number."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 12), 16, 10).cast("long")


def summarize(rotated: DataFrame) -> DataFrame:
    """One row for each rotation: turns, lengths, masked length and a digest of text, order and masks."""
    n = F.length("rendered").cast("long")
    line = F.concat_ws(":", "begin", F.coalesce(F.col("mask_begin").cast("string"), F.lit("-")), F.coalesce(F.col("mask_end").cast("string"), F.lit("-")), "rendered")
    own = F.col("mask_begin").isNotNull()
    return rotated.groupBy("conv_id", "speaker").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if(own).alias("n_masks"), F.sum(n).alias("n_chars"),
        F.coalesce(F.sum(F.col("mask_end") - F.col("mask_begin")), F.lit(0).cast("long")).alias("masked_chars"),
        (F.sum(part(line) % 1_000_000_007) % 1_000_000_007).alias("digest"),
    )


ORACLE = """
with said as (
  select conv_id, turn, replace(replace(coalesce(nullif(role, ''), 'unknown'), '<|', '<\\|'), '|>', '|\\>') as role,
    replace(replace(coalesce(text, ''), '<|', '<\\|'), '|>', '|\\>') as text from conversations),
speakers as (select distinct conv_id, role as speaker from said where role <> 'system'),
lines as (
  select s.conv_id, p.speaker, s.turn, s.role, s.text,
    case when s.role = p.speaker then '<|assistant|>' || chr(10) when s.role = 'system' then '<|system|>' || chr(10)
         else '<|user:' || s.role || '|>' || chr(10) end as head
  from said s join speakers p on s.conv_id is not distinct from p.conv_id),
placed as (
  select *, head || text || '<|end|>' || chr(10) as rendered from lines),
begun as (
  select *, coalesce(sum(length(rendered)) over (partition by conv_id, speaker order by turn nulls last, role, text
    rows between unbounded preceding and 1 preceding), 0)::bigint as b from placed),
masked as (
  select *, case when role = speaker then b + length(head) end as mb, case when role = speaker then b + length(rendered) - 1 end as me from begun)
select conv_id, speaker, count(*)::bigint as n_turns, count(mb)::bigint as n_masks, sum(length(rendered))::bigint as n_chars,
  coalesce(sum(me - mb), 0)::bigint as masked_chars,
  (sum(('0x' || substr(md5(b::varchar || ':' || coalesce(mb::varchar, '-') || ':' || coalesce(me::varchar, '-') || ':' || rendered), 1, 12))::bigint % 1000000007) % 1000000007)::bigint as digest
from masked group by conv_id, speaker
"""
