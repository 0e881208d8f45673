"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(documents(spark, sf_dir))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontamination

    return decontamination.overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tool_calls

    return tool_calls.link(table(spark, sf_dir, "conversations"))


def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_layout

    return html_layout.extract(table(spark, sf_dir, "pages"))


def op5_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repetition

    return repetition.rules(documents(spark, sf_dir))


def op6_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_tree

    return suffix_tree.score(documents(spark, sf_dir))


def op7_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import content_store, scratch

    path = scratch.folder(spark, "store")
    content_store.write(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return content_store.digests(spark, path)


def op10_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op8_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (numbers of the lines that went, from 0), kept_crc32 (of the text that stays)."""
    from . import lines

    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("n_lines", F.size(F.split("text", "\n")).cast("bigint"))
    out = lines.dedup(docs, removed="removed")
    return out.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed", F.crc32(F.col("text").cast("binary")).alias("kept_crc32"))


def op9_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cotraining

    return cotraining.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bin_completion

    return bin_completion.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance

    return importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import turn_repair

    return turn_repair.digests(turn_repair.damaged(table(spark, sf_dir, "conversations")), table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ngram_jaccard_join,
        op2_spaced_seed_decontamination,
        op3_tool_call_linking,
        op4_html_layout,
        op5_repetition_coverage,
        op6_suffix_tree_scoring,
        op7_content_store,
        op8_fuzzy_line_dedup,
        op9_cotraining_quality,
        op10_sum_of_squares_packing,
        op11_bin_completion,
        op12_importance_resampling,
        op13_conversation_repair,
    )
    return {f.__name__: f for f in every}


#: The same rows from DuckDB; the table's turns hold no structured calls and no two share a conversation and number.
TOOL_CALLS_SQL = """
with parts as (
  select conv_id, turn, role, text, count(*) as copies,
    case role when 'user' then 'call' when 'assistant' then 'result' else 'message' end as kind,
    case role when 'user' then concat('turn-', conv_id, '-', turn) when 'assistant' then concat('turn-', conv_id, '-', turn - 1) end as call_id
  from conversations group by conv_id, turn, role, text),
joined as (
  select p.*, o.turn is not null as met from parts p left join parts o
    on p.kind in ('call', 'result') and o.conv_id = p.conv_id and o.call_id = p.call_id and o.kind = case p.kind when 'call' then 'result' else 'call' end),
placed as (
  select *, case kind when 'call' then case when met then 'linked' else 'unanswered' end when 'result' then case when met then 'linked' else 'orphan' end end as status,
    case when kind = 'call' then 0 when kind = 'result' and met then 1 end as step,
    case when kind = 'call' and text is null then 'text: missing' when kind = 'call' and length(text) > 400 then 'text: longer than 400' else '' end as errors
  from joined)
select conv_id, turn, cast(0 as int) as place, copies, kind, call_id, cast(step as int) as step, status, errors = '' as valid, errors,
  case kind
    when 'call' then concat('{"arguments":{"text":', coalesce(cast(to_json(text) as varchar), 'null'), ',"turn":', turn, '},"call_id":"', call_id, '","kind":"call","name":"reply","step":', step, ',"turn":', turn, '}')
    when 'result' then concat('{"call_id":"', call_id, '","content":', coalesce(cast(to_json(text) as varchar), 'null'), ',"kind":"result","step":', coalesce(cast(step as varchar), 'null'), ',"turn":', turn, '}')
    else concat('{"content":', coalesce(cast(to_json(text) as varchar), 'null'), ',"kind":"message","role":"', role, '","turn":', turn, '}') end as json
from placed
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_tool_call_linking": TOOL_CALLS_SQL}
