"""Retrieval end to end (C15) and prompt assembly.

query text -> embedding -> exact cosine top-k over the knowledge base ->
context text per query; queries without hits get the fixed "none" sentence.
Many queries (dates, questions) run in one job.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.render import analyst_prompt, context_or_none, render_context
from ..operators.vectors import cosine_topk


def retrieve(kb: DataFrame, queries: DataFrame, embed: Callable[[DataFrame, str], DataFrame],
             k: int = 10, query_id: str = "qid", query_text: str = "query") -> DataFrame:
    """(query_id, context).  ``kb`` has id, embedding, document, metadata;
    ``embed(df, text_col)`` adds an ``embedding`` column."""
    # the query set is read twice (scoring, and the final left join that keeps
    # queries without hits): cut its lineage once with a reliable checkpoint
    queries = queries.select(query_id, query_text).checkpoint(eager=True)
    qv = embed(queries, query_text).withColumnRenamed("embedding", "_qv")
    docs = kb.select("id", "embedding")
    hits = cosine_topk(docs, qv, k, doc_id="id", doc_vec="embedding", query_id=query_id, query_vec="_qv")
    meta = kb.select("id", "document", "metadata")
    rows = hits.join(meta, "id").select(
        query_id, "rank", "similarity", "document",
        F.col("metadata.title").alias("title"), F.col("metadata.source").alias("source"),
        F.col("metadata.date").alias("date"))
    ctx = render_context(rows, [query_id])
    return queries.select(query_id).join(ctx, query_id, "left").select(query_id, context_or_none(F.col("context")).alias("context"))


def build_prompts(focus: DataFrame, contexts: DataFrame, key: list[str],
                  system_prompts: Mapping[str, str], schema_text: Mapping[str, str]) -> DataFrame:
    """(key..., analyst, system, user) rows, one per analyst and key."""
    sys_map = F.create_map(*[x for kv in system_prompts.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    sch_map = F.create_map(*[x for kv in schema_text.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    j = focus.join(contexts, key, "left")
    return j.select(
        *key, "analyst",
        F.element_at(sys_map, F.col("analyst")).alias("system"),
        analyst_prompt(F.col("focus"), F.col("context"), F.element_at(sch_map, F.col("analyst"))).alias("user"),
    )
