"""Chat formatting of preference pairs, with DataFrame functions only.

Chosen and rejected conversations of a pair are compared turn by turn; the longest common prefix is
rendered once as the prompt, what follows as two completions. Masks give the spans, in code points,
that carry loss: the words of the assistant and the mark that ends its turn.

Edge cases: null texts count as empty, null roles as ``user``; turns are ordered by turn, then role
and text, so ties have one order and repeated turns stay; a conversation missing on one side has an
empty completion there; equal conversations are all prompt; rows with a null key are dropped; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import prepare, table


def numbered(turns: DataFrame) -> DataFrame:
    """pair_id, i, role and text, i counting the turns of a pair from 0."""
    turns = turns.where("pair_id is not null").select("pair_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    return turns.select("pair_id", (F.row_number().over(order) - 1).cast("bigint").alias("i"), "role", "text")


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Per pair_id: n_prefix, prompt, chosen, rejected, chosen_mask and rejected_mask.

    Both inputs hold turns: pair_id, turn, role, text. A mask is start:stop of each span, joined by commas.
    """
    prepare(chosen.sparkSession)
    one, two = numbered(chosen), numbered(rejected)
    sides = one.withColumn("side", F.lit("chosen")).union(two.withColumn("side", F.lit("rejected")))
    # a turn is common if both sides have it alike; the prefix ends before the first that isn't
    turns = sides.groupBy("pair_id", "i").agg((F.count("*") == 2).alias("both"), F.min(F.struct("role", "text")).alias("lo"), F.max(F.struct("role", "text")).alias("hi"))
    ends = turns.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~(F.col("both") & (F.col("lo") == F.col("hi"))), F.col("i"))), F.count("*")).alias("n_prefix"))
    rows = sides.join(ends, "pair_id").withColumn("part", F.when(F.col("i") < F.col("n_prefix"), "prompt").otherwise(F.col("side")))
    rows = rows.where("part <> 'prompt' or side = 'chosen'")
    head = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    rows = rows.select("pair_id", "n_prefix", "part", "i", "role", F.length(head).alias("head"), F.concat(head, "text", F.lit("<|end|>\n")).alias("piece"))
    before = Window.partitionBy("pair_id", "part").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
    span = F.when(F.col("role") == "assistant", F.concat((F.col("at") + F.col("head")).cast("string"), F.lit(":"), (F.col("at") + F.length("piece")).cast("string")))
    rows = rows.withColumn("span", span)

    def part(name: str, column: str, between: str, alias: str) -> F.Column:
        kept = F.array_sort(F.collect_list(F.when((F.col("part") == name) & F.col(column).isNotNull(), F.struct("i", column))))
        return F.array_join(F.transform(kept, lambda x: x[column]), between).alias(alias)

    return rows.groupBy("pair_id").agg(
        F.max("n_prefix").alias("n_prefix"), part("prompt", "piece", "", "prompt"), part("chosen", "piece", "", "chosen"), part("rejected", "piece", "", "rejected"),
        part("chosen", "span", ",", "chosen_mask"), part("rejected", "span", ",", "rejected_mask"),
    )


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen; rejected is the same up to its last assistant turn, which takes
    the last assistant text of the conversation whose id differs in the lowest bit (else: empty)."""
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    last = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("l"))
    other = last.select(F.expr("pair_id ^ 1").alias("pair_id"), F.col("l.text").alias("other"))
    with_last = turns.join(last, "pair_id", "left").where("l is null or turn <= l.turn")
    swapped = with_last.join(other, "pair_id", "left").select("pair_id", "turn", "role", F.expr("if(role = 'assistant' and turn = l.turn, coalesce(other, ''), text)").alias("text"))
    return preferences(turns, swapped)


OP3_SQL = """
with t as (select conv_id pair_id, turn, coalesce(role, 'user') as role, coalesce(text, '') as text from conversations where conv_id is not null),
last as (select pair_id, max(struct_pack(turn := turn, text := text)) l from t where role = 'assistant' group by pair_id),
swapped as (
  select t.pair_id, t.turn, t.role, case when t.role = 'assistant' and t.turn = last.l.turn then coalesce(o.l.text, '') else t.text end as text
  from t left join last using (pair_id) left join last o on o.pair_id = xor(t.pair_id, 1) where last.l is null or t.turn <= last.l.turn),
one as (select pair_id, row_number() over (partition by pair_id order by turn, role, text) - 1 i, role, text from t),
two as (select pair_id, row_number() over (partition by pair_id order by turn, role, text) - 1 i, role, text from swapped),
ends as (
  select coalesce(one.pair_id, two.pair_id) pair_id,
    coalesce(min(case when one.role is not distinct from two.role and one.text is not distinct from two.text then null else coalesce(one.i, two.i) end), count(*)) n_prefix
  from one full join two on one.pair_id = two.pair_id and one.i = two.i group by 1),
part_rows as (
  select pair_id, n_prefix, case when i < n_prefix then 'prompt' else 'chosen' end part, i, role, text from one join ends using (pair_id)
  union all select pair_id, n_prefix, 'rejected', i, role, text from two join ends using (pair_id) where i >= n_prefix),
pieces as (select *, '<|' || role || '|>' || chr(10) as head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as piece from part_rows),
placed as (select *, coalesce(sum(length(piece)) over (partition by pair_id, part order by i rows between unbounded preceding and 1 preceding), 0) as at_ from pieces),
spans as (select *, case when role = 'assistant' then cast(cast(at_ + length(head) as bigint) as varchar) || ':' || cast(cast(at_ + length(piece) as bigint) as varchar) end span from placed)
select pair_id, max(n_prefix) n_prefix,
  coalesce(string_agg(piece, '' order by i) filter (where part = 'prompt'), '') prompt,
  coalesce(string_agg(piece, '' order by i) filter (where part = 'chosen'), '') chosen,
  coalesce(string_agg(piece, '' order by i) filter (where part = 'rejected'), '') rejected,
  coalesce(string_agg(span, ',' order by i) filter (where part = 'chosen'), '') chosen_mask,
  coalesce(string_agg(span, ',' order by i) filter (where part = 'rejected'), '') rejected_mask
from spans group by pair_id
"""
