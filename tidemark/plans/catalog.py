"""Registered queries: one per operator of the inventory, bound to the test tables.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame that reads the
whole input tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import money_sum, round_half_up
from ..operators import asof as _asof
from ..operators import breadth as _breadth
from ..operators import concentration as _conc
from ..operators import rank as _rank
from ..operators import rollups as _rollups
from ..operators import topn as _topn
from ..operators import valuation as _val
from ..operators.clean import with_bar_return
from ..session import materialize, scratch_path
from ..sinks.writers import write_daily
from ..functions.text import md5_id
from ..operators import joins as _joins
from ..operators import news as _news
from ..operators import upsert as _upsert
from ..functions.numeric import exact_mean
from ..operators import embed as _embed
from ..operators import vector_index as _index
from ..operators import vectors as _vec
from ..functions.text import fence_body
from ..operators import boards as _boards
from ..operators import daily_state as _state
from ..operators import evaluate as _eval
from ..operators import gather as _gather
from ..operators import render as _render
from ..operators import snapshot as _snap
from ..operators import structured as _struct
from .. import schemas as _schemas
from . import bindings as B
from . import retrieval as _retrieval

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- quotes


@register("market_summary")
def market_summary(spark, sf):
    return _breadth.breadth(B.quotes(spark, sf))


@register("clean_quotes")
def clean_quotes(spark, sf):
    return B.quotes(spark, sf).select("code", "name", "price", "change_pct", "volume_num", "amount_num")


@register("top_gainers")
def top_gainers(spark, sf):
    return _topn.top_n(B.quotes(spark, sf), "change_pct", 20, desc=True, cols=["code", "name", "change_pct"])


@register("top_losers")
def top_losers(spark, sf):
    return _topn.top_n(B.quotes(spark, sf), "change_pct", 20, desc=False, cols=["code", "name", "change_pct"])


@register("top_amount")
def top_amount(spark, sf):
    top = _topn.top_n(B.quotes(spark, sf), "amount_num", 20, desc=True, cols=["code", "name", "amount_num", "change_pct"])
    return top.select("code", "name", round_half_up("amount_num", 0).alias("amount"), "change_pct")


@register("sector_stats")
def sector_stats(spark, sf):
    return _rollups.rollup_by(B.quotes(spark, sf), "sector")


@register("sector_top3")
def sector_top3(spark, sf):
    q = B.quotes(spark, sf)
    top = _topn.top_n(q, "amount_num", 3, desc=True, by=["sector"], cols=["code", "amount_num"])
    return top.select("sector", "code", F.col("amount_num").alias("amount"))


@register("big_losers")
def big_losers(spark, sf):
    losers = _topn.top_n(B.quotes(spark, sf), "change_pct", 20, desc=False, cols=["code", "change_pct"])
    return _topn.big_movers(losers, "change_pct", 5.0).agg(F.count(F.lit(1)).alias("n"))


@register("concentration")
def concentration(spark, sf):
    return _conc.concentration(B.quotes(spark, sf), "amount_num", (10, 50))


@register("amount_rank")
def amount_rank(spark, sf):
    q = B.quotes(spark, sf).select("code", "amount_num")
    ranked = _rank.row_number_by(q, [F.col("amount_num").desc_nulls_last(), F.col("code").asc()])
    total = q.agg(round_half_up(money_sum("amount_num"), 0))
    return ranked.select("code", "rn", total.scalar().alias("total_market_amount"))


# ---------------------------------------------------------------- bars / valuation


@register("index_range_stats")
def index_range_stats(spark, sf):
    return _rollups.range_stats(B.bars(spark, sf))


@register("bar_return")
def bar_return(spark, sf):
    b = with_bar_return(B.bars(spark, sf))
    return b.where(F.col("change_pct").isNotNull()).select("d", "change_pct")


@register("pe_by_year")
def pe_by_year(spark, sf):
    o = B.table(spark, sf, "orders")
    return _rollups.period_mean(o, "o_orderdate", "o_totalprice", "year", 2, "avg_pe_val")


@register("pe_percentile")
def pe_percentile(spark, sf):
    y = B.yearly(spark, sf)
    return _val.valuation_position(y, order="yr", value="v")


# ---------------------------------------------------------------- news / knowledge base


# Fixed value of the binding: the batch date stamped on the pages "drop".
PAGES_BATCH_DATE = "20240101"


@register("news_dedup")
def news_dedup(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    d = _news.with_url(d, "text").withColumn("id", md5_id("text"))
    first = _news.dedupe_first(d, "id", ["doc_id"])
    return first.where(F.length("text") >= 20).select("id", "doc_id", F.length("text").cast("long").alias("n"))


@register("kb_upsert")
def kb_upsert(spark, sf):
    d = B.table(spark, sf, "documents")
    u = d.select(md5_id("text").alias("id"), "doc_id", "source", (F.col("doc_id") % 7).alias("batch"))
    merged = _upsert.upsert_latest(None, u, key="id", version="batch", order=["doc_id"])
    return merged.select("id", "doc_id", "source", "batch")


def _news_feeds(spark, sf):
    docs = B.table(spark, sf, "documents")
    pages = B.table(spark, sf, "pages")
    conv = B.table(spark, sf, "conversations")
    day = PAGES_BATCH_DATE
    return [
        _news.normalise_news(docs, _news.SourceMapping(
            source="documents", title=F.col("text"), content=F.col("text"),
            url=F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))), day),
        _news.normalise_news(pages, _news.SourceMapping(
            source="pages", title=F.regexp_extract("html", "<title>(.*?)</title>", 1),
            title_fallback=F.col("html"), content=F.col("html"), url=F.col("url")), day),
        _news.normalise_news(conv, _news.SourceMapping(
            source="conversations", title=F.col("text"), content=F.col("text"),
            url=F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))), day),
    ]


@register("news_union")
def news_union(spark, sf):
    return _news.union_sources(_news_feeds(spark, sf)).select("url", "title", "source")


@register("news_metadata")
def news_metadata(spark, sf):
    pages = B.table(spark, sf, "pages")
    news = pages.select(
        "page_id",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.col("html").alias("content"),
        F.lit(None).cast("string").alias("source"),
        "url",
    )
    kb = _news.prepare_articles(news, PAGES_BATCH_DATE, order=["page_id"])
    return kb.select(
        "id",
        F.col("metadata.title").alias("title"),
        F.col("metadata.source").alias("source"),
        F.col("metadata.date").alias("date"),
        F.col("metadata.url").alias("url"),
        F.length("document").cast("long").alias("n"),
    )


@register("semi_topk")
def semi_topk(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    totals = o.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    top = _topn.top_n(totals, "total", 20, tiebreak=("o_custkey",), cols=["o_custkey"])
    return _joins.semi_in(o, top, "o_custkey")


@register("new_only_anti")
def new_only_anti(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang", "source")
    return _joins.new_only(d, B.table(spark, sf, "labels"), "doc_id")


@register("sector_left_join")
def sector_left_join(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "lang")
    lab = B.table(spark, sf, "labels").select("doc_id", "quality")
    j = _joins.with_sector(d, lab, key="doc_id", dim="quality", out="quality", version=None)
    return (j.where(F.col("quality").isNotNull()).groupBy("lang")
            .agg(F.count(F.lit(1)).alias("n"), round_half_up(exact_mean("quality"), 4).alias("avg_quality")))


# ---------------------------------------------------------------- vectors / embeddings



def _label_queries(spark, sf):
    e = B.table(spark, sf, "embeddings")
    return _vec.centroids(e, "embedding", by=["label"], out="query")


@register("vector_topk")
def vector_topk(spark, sf):
    e = B.table(spark, sf, "embeddings")
    q = _vec.centroids(e, "embedding", out="query").withColumn("qid", F.lit(0))
    top = _vec.cosine_topk(e, q, 10, doc_id="vec_id", doc_vec="embedding", query_id="qid", query_vec="query")
    return top.select("rank", "vec_id", "similarity")


@register("vector_topk_many")
def vector_topk_many(spark, sf):
    e = B.table(spark, sf, "embeddings")
    top = _vec.cosine_topk(e, _label_queries(spark, sf), 10, doc_id="vec_id", doc_vec="embedding",
                           query_id="label", query_vec="query")
    return top.select("label", "rank", "vec_id", "similarity")


def row_queries(e):
    """Every row whose id is divisible by 20, as a query."""
    return e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


@register("vector_topk_rows")
def vector_topk_rows(spark, sf):
    """The rows with an id divisible by 20 against all rows, themselves included."""
    e = B.table(spark, sf, "embeddings")
    top = _vec.cosine_topk(e, row_queries(e), 10, doc_id="vec_id", doc_vec="embedding", query_id="qid", query_vec="query")
    return top.select("qid", "rank", "vec_id", "similarity")


@register("vector_topk_lsh")
def vector_topk_lsh(spark, sf):
    e = B.table(spark, sf, "embeddings")
    top = _vec.cosine_topk_lsh(e, _label_queries(spark, sf), 10, doc_id="vec_id", doc_vec="embedding",
                               query_id="label", query_vec="query", bucket_length=0.3, tables=4)
    return top.select("label", "rank", "vec_id", "similarity")


@register("embed_hash")
def embed_hash(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    return _embed.hash_embed(d, "text", dims=256).select("doc_id", "embedding")


# ---------------------------------------------------------------- structured outputs, routing, gather


@register("fence_extract")
def fence_extract(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    wrapped = F.concat(F.lit("pre ```json\n"), F.col("text"), F.lit("\n``` post"))
    return d.select("doc_id", fence_body(wrapped).alias("body"))


def _conversation_answers(spark, sf):
    """Model answers derived from conversation turns: user turns are prose (not
    JSON), assistant turns a fenced technical-analyst object whose confidence
    is length/1000 (out of range above 1000 chars), system turns an object
    without its required fields."""
    c = B.table(spark, sf, "conversations")
    conf = (F.length("text") / F.lit(1000.0)).cast("string")
    obj = F.concat(F.lit('{"trend": "震荡", "trend_strength": "中等", "index_summary": "turn '),
                   F.col("turn").cast("string"), F.lit('", "momentum_signals": ["a", "b"], "confidence": "'),
                   conf, F.lit('"}'))
    raw = (F.when(F.col("role") == "user", F.col("text"))
           .when(F.col("role") == "assistant", F.concat(F.lit("answer:\n```json\n"), obj, F.lit("\n```")))
           .otherwise(F.lit('{"trend": "上涨"}')))
    return c.select("conv_id", "turn", "role", raw.alias("raw"))


@register("structured_parse")
def structured_parse(spark, sf):
    parsed = _struct.parse_structured(_conversation_answers(spark, sf), "raw", "technical")
    return parsed.select("conv_id", "turn", "status", F.col("parsed.confidence").alias("confidence"))


@register("structured_parse_risk")
def structured_parse_risk(spark, sf):
    """Risk answers that carry the whole turn: prose, missing fields, wrong
    element types and values out of range follow from the text's length."""
    c = B.table(spark, sf, "conversations")
    n = F.length("text")
    head = F.regexp_replace(F.to_json(F.struct(F.col("text").alias("concentration_risk"), F.col("role").alias("volatility_assessment"))), "\\}$", "")
    warnings = F.when(n % 5 == 0, F.lit("[1, 2]")).when(n % 5 == 1, F.lit("[null]")).otherwise(F.lit('["a", "b"]'))
    level = F.when(n % 7 == 0, F.lit("")).otherwise(F.lit(', "overall_risk_level": "low"'))
    obj = F.concat(head, F.lit(', "external_risks": ["x"], "stock_warnings": '), warnings, F.lit(', "fragility_score": "'),
                   (n / F.lit(400.0)).cast("string"), F.lit('", "confidence": 0.5'), level, F.lit("}"))
    raw = F.when(n % 11 == 0, F.col("text")).otherwise(obj)
    parsed = _struct.parse_structured(c.select("conv_id", "turn", raw.alias("raw")), "raw", "risk")
    return parsed.select("conv_id", "turn", "status", F.col("parsed.fragility_score").alias("fragility"),
                         F.length("parsed.concentration_risk").cast("long").alias("n_risk"))


@register("gather_defaults")
def gather_defaults(spark, sf):
    c = B.table(spark, sf, "conversations")
    res = c.select("conv_id", "role", F.length("text").cast("long").alias("v"))
    return _gather.gather(res, ["conv_id"], "role", "v", kinds=["user", "assistant", "system"],
                          defaults={"system": F.lit(-1).cast("long")})


@register("label_route")
def label_route(spark, sf):
    c = B.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", _gather.label_route("text", rules=[("the", "stock"), ("ou", "no_data")]).alias("label"))


# ---------------------------------------------------------------- reports, evaluation


def _conversation_reports(spark, sf):
    """Reports derived from conversations: one per conversation, one section
    per turn, user turns as highlights, system turns as disagreements."""
    c = B.table(spark, sf, "conversations")
    turns = c.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"),
        F.min_by("text", "turn").alias("summary"),
    )
    return turns.select(
        F.col("conv_id").cast("string").alias("report_date"),
        "conv_id",
        "summary",
        F.transform("t", lambda s: F.struct(s["role"].alias("heading"), s["text"].alias("content"),
                                            s["role"].alias("source_agent"))).alias("sections"),
        F.lit("中性").alias("overall_sentiment"),
        F.lit("medium").alias("risk_level"),
        F.transform(F.filter("t", lambda s: s["role"] == "user"), lambda s: s["text"]).alias("key_highlights"),
        F.transform(F.filter("t", lambda s: s["role"] == "system"), lambda s: s["text"]).alias("contradictions_resolved"),
    )


@register("report_quality")
def report_quality(spark, sf):
    c = B.table(spark, sf, "conversations").select("conv_id", F.col("text").alias("content"), "role")
    return _eval.report_quality_rows(c, ["conv_id"], "content", is_highlight=F.col("role") == "user",
                                     is_contradiction=F.col("role") == "system",
                                     min_words=100, max_words=2000, min_sections=4, min_highlights=2)


@register("render_report")
def render_report(spark, sf):
    rep = _conversation_reports(spark, sf)
    md = _render.render_report(F.col("report_date"), F.col("summary"), F.col("sections"),
                               F.col("overall_sentiment"), F.col("risk_level"),
                               F.col("key_highlights"), F.col("contradictions_resolved"))
    return rep.select("conv_id", md.alias("markdown"))


@register("render_context")
def render_context(spark, sf):
    c = B.table(spark, sf, "conversations")
    hits = c.select(
        "conv_id",
        (F.col("turn") + 1).alias("rank"),
        F.col("role").alias("title"),
        F.lit("conversations").alias("source"),
        F.lit(None).cast("string").alias("date"),
        (F.lit(1.0) / (F.col("turn") + 1)).alias("similarity"),
        F.col("text").alias("document"),
    )
    return _render.render_context(hits, ["conv_id"])


@register("judge_score")
def judge_score(spark, sf):
    e = B.table(spark, sf, "events")
    ctx = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_type"))
    return e.select(
        "event_id",
        _eval.judge_score(F.col("props"), "k").alias("k_score"),
        _eval.judge_score(F.col("props"), "score").alias("absent_score"),
        _eval.judge_score(F.col("props"), "k", context=ctx).alias("retrieval"),
    )


@register("eval_overall")
def eval_overall(spark, sf):
    lab = B.table(spark, sf, "labels")
    return lab.select(
        "doc_id",
        _eval.overall_score(F.col("quality").cast("double"), (F.lit(1) - F.col("toxic")).cast("double"),
                            F.col("toxic") == 0).alias("overall"),
    )


def _risk_results(spark, sf):
    lab = B.table(spark, sf, "labels")
    result = F.struct(
        F.when(F.col("toxic") == 1, F.lit("high")).otherwise(F.lit("low")).alias("overall_risk_level"),
        (F.lit(0.15) + F.lit(0.7) * F.col("toxic")).alias("fragility_score"),
        (F.lit(0.5) + F.lit(0.25) * F.col("quality")).alias("confidence"),
    )
    failed = (F.col("quality") == 0) & (F.col("toxic") == 1)
    return lab.select("doc_id", F.lit("risk").alias("analyst"), F.when(~failed, result).alias("result"))


@register("render_answer")
def render_answer(spark, sf):
    r = _risk_results(spark, sf)
    brief = F.when(F.col("result").isNotNull(), _render.analyst_brief("risk", F.col("result")))
    line = _render.answer_row(_render.display_name("risk"), brief, F.col("result.confidence"))
    return r.select("doc_id", line.alias("line"))


# ---------------------------------------------------------------- snapshot, focus text, boards


def _snapshot(spark, sf):
    # All pieces come from the cleaned quotes: one small row per stock, written
    # once, so that lineitem is scanned once however many pieces there are.
    q = materialize(B.quotes(spark, sf), "quotes")
    spot = _breadth.breadth(q)
    pe = _val.valuation_position(B.yearly(spark, sf), order="yr", value="v")
    gain = _topn.top_n(q, "change_pct", 20, cols=["code", "name", "change_pct"])
    lose = _topn.top_n(q, "change_pct", 20, desc=False, cols=["code", "name", "change_pct"])
    amt = _topn.top_n(q, "amount_num", 20, cols=["code", "name", "amount_num", "change_pct"]).select(
        "code", "name", round_half_up("amount_num", 0).alias("amount"), "change_pct", "amount_num")
    sectors = _rollups.rollup_by(q, "sector")
    conc = _conc.concentration(q, "amount_num", (10, 50))
    bars = B.bars(spark, sf)
    idx = _rollups.range_stats(bars)
    last = with_bar_return(bars).agg(
        F.max_by("close", "d").alias("close"),
        round_half_up(exact_mean("change_pct"), 2).alias("avg_change_pct"),
    )
    idx = idx.withColumn("close", last.select("close").scalar()).withColumn(
        "avg_change_pct", last.select("avg_change_pct").scalar())
    pieces = {
        "spot_summary": _snap.as_struct(spot, "spot_summary"),
        "pe": _snap.as_struct(pe, "pe"),
        "top_gainers": _snap.as_list(gain, "top_gainers", ["change_pct", "code"], desc=[True, False]),
        "top_losers": _snap.as_list(lose, "top_losers", ["change_pct", "code"]),
        "top_amount": _snap.as_list(amt, "top_amount", ["amount_num", "code"], desc=[True, False]),
        "sector_stats": _snap.as_list(sectors, "sector_stats", ["avg_change", "sector"], desc=[True, False]),
        "concentration": _snap.as_struct(conc, "concentration"),
        "index_stats": _snap.as_struct(idx, "index_stats"),
    }
    return _snap.snapshot(pieces)


@register("market_snapshot")
def market_snapshot(spark, sf):
    return _snapshot(spark, sf)


@register("focus_text")
def focus_text(spark, sf):
    return _render.focus_texts(_snapshot(spark, sf), [])


@register("search_query")
def search_query(spark, sf):
    s = _snapshot(spark, sf)
    return s.select(_render.search_query(F.col("spot_summary"), F.col("top_gainers"), F.col("top_amount")).alias("query"))


@register("sector_map_flatten")
def sector_map_flatten(spark, sf):
    p = B.table(spark, sf, "part")
    boards = p.groupBy(F.col("p_brand").alias("industry")).agg(
        F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("name"))).alias("constituents"))
    return _boards.flatten_boards(boards)


@register("concentration_by")
def concentration_by(spark, sf):
    li = B.table(spark, sf, "lineitem").select("l_partkey", F.col("l_extendedprice").alias("amount"))
    part = B.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sector"))
    lines = _joins.with_dimension(li, part, "l_partkey", how="inner")
    return _conc.concentration(lines, "amount", (10, 50), by=["sector"])


# ---------------------------------------------------------------- retrieval end to end, prompts



def _knowledge_base(spark, sf):
    d = B.table(spark, sf, "documents")
    news = d.select("doc_id", F.substring("text", 1, 100).alias("title"), F.col("text").alias("content"),
                    "source", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"))
    kb = _news.prepare_articles(news, PAGES_BATCH_DATE, order=["doc_id"])
    # The knowledge base is a table (K5): scoring reads its vectors, the winners their texts.
    return materialize(_embed.hash_embed(kb, "document", dims=512), "knowledge-base")


def _context_for(spark, sf, snapshot):
    q = snapshot.select(F.lit(0).alias("qid"), _render.search_query(F.col("spot_summary"), F.col("top_gainers"),
                                                                    F.col("top_amount")).alias("query"))
    return _retrieval.retrieve(_knowledge_base(spark, sf), q, lambda df, c: _embed.hash_embed(df, c, dims=512), k=10)


@register("retrieve_context")
def retrieve_context(spark, sf):
    return _context_for(spark, sf, _snapshot(spark, sf))


@register("analyst_prompts")
def analyst_prompts(spark, sf):
    # one snapshot row feeds both the focus texts and the retrieval query;
    # it is a single row, so it is materialised once (reliable checkpoint)
    snap = _snapshot(spark, sf).checkpoint(eager=True)
    focus = _render.focus_texts(snap, []).withColumn("qid", F.lit(0))
    ctx = _context_for(spark, sf, snap)
    systems = {k: f"{k} analyst" for k in _schemas.ANALYSTS}
    asked = {k: _schemas.json_schema(v, _struct.OPTIONAL.get(k, set())) for k, v in _schemas.ANALYST_SCHEMAS.items()}
    return _retrieval.build_prompts(focus, ctx, ["qid"], systems, asked)


@register("vector_topk_ivf")
def vector_topk_ivf(spark, sf):
    e = B.table(spark, sf, "embeddings")
    top = _vec.cosine_topk_ivf(e, _label_queries(spark, sf), 10, doc_id="vec_id", doc_vec="embedding",
                               query_id="label", query_vec="query", cells=8, probes=7)
    return top.select("label", "rank", "vec_id", "similarity")


# ---------------------------------------------------------------- vendor codes, cards, landing, the upserted table


@register("sector_vendor_codes")
def sector_vendor_codes(spark, sf):
    """Quotes with exchange prefixes against a map with bare numbers."""
    number = lambda c: F.lpad(F.col(c).cast("string"), 6, "0")
    traded = B.table(spark, sf, "lineitem").select("l_partkey").distinct().select(
        F.concat(F.lit("sh"), number("l_partkey")).alias("code"), F.lit("traded").alias("industry"))
    parts = B.table(spark, sf, "part").select(F.concat(number("p_partkey"), F.lit(".SZ")).alias("code"), "p_brand")
    j = _joins.with_sector(parts, traded, out="traded", version=None, vendor_codes=True)
    return j.groupBy(F.col("p_brand").alias("industry_name")).agg(
        F.count(F.lit(1)).alias("stock_count"), F.count_if(F.col("traded").isNull()).alias("unmatched"))


@register("eval_cards")
def eval_cards(spark, sf):
    lab = B.table(spark, sf, "labels")
    card = _eval.eval_card(F.col("doc_id").cast("string"), F.col("quality").cast("double"), (F.lit(1) - F.col("toxic")).cast("double"),
                           F.struct((F.col("toxic") == 0).alias("pass")))
    return lab.select("doc_id", card.alias("card")).select("doc_id", "card.overall_score", _render.score_table(F.col("card")).alias("score_table"))


@register("daily_landing")
def daily_landing(spark, sf):
    """Orders landed by the first of their month, a part of them again, and read
    back: a rerun replaces its dates."""
    days = B.table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("trade_date"), "o_orderkey")
    path = scratch_path(spark, "landing")
    write_daily(days, path)
    write_daily(days.where(F.col("trade_date") < "1995-01-01"), path)
    return spark.read.parquet(path).groupBy("trade_date").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@register("kb_table_upsert")
def kb_table_upsert(spark, sf):
    """The stored table after two upserts: the early batches, then all of them."""
    d = B.table(spark, sf, "documents")
    u = d.select(md5_id("text").alias("id"), "doc_id", "source", (F.col("doc_id") % 7).alias("batch"))
    path = scratch_path(spark, "kb")
    _upsert.upsert_table(spark, path, u.where("batch < 4"), "id", "batch", order=["doc_id"], buckets=16)
    _upsert.upsert_table(spark, path, u, "id", "batch", order=["doc_id"], buckets=7)  # dealt anew
    return spark.read.parquet(path).select("id", "doc_id", "source", "batch")


# ---------------------------------------------------------------- as of a date


@register("sector_asof")
def sector_asof(spark, sf):
    """Lines as quotes; a customer's orders as the maps landed for that code over time."""
    quotes = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("code"), F.to_date("l_shipdate").alias("trade_date"))
    maps = B.table(spark, sf, "orders").select(F.col("o_custkey").alias("code"), F.to_date("o_orderdate").alias("trade_date"), F.col("o_orderpriority").alias("industry"))
    return _asof.with_sector_asof(quotes, maps)


@register("pe_percentile_asof")
def pe_percentile_asof(spark, sf):
    """For every order date, where its mean price stands among the earlier dates'."""
    return _asof.position_asof(B.daily_value(spark, sf), "d", "v")


@register("price_percentile_asof")
def price_percentile_asof(spark, sf):
    """For every order, where its price stands among its priority's orders of earlier dates."""
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    got = _asof.position_asof(o, "o_orderdate", "o_totalprice", by=["o_orderpriority"])
    return got.select("o_orderkey", "n_earlier", "percentile")


@register("index_trailing_year")
def index_trailing_year(spark, sf):
    """The 365 days up to each day of ``events``."""
    return _asof.trailing_stats(B.bars(spark, sf), "d").select("d", "n_bars", "close_min", "close_max", "close_avg", "volatility")


@register("order_trailing_year")
def order_trailing_year(spark, sf):
    """The 365 days up to each order date, for each priority as an index of its own."""
    got = _asof.trailing_stats(B.order_bars(spark, sf), "d", by=["o_orderpriority"])
    return got.select("o_orderpriority", "d", "n_bars", "close_min", "close_max", "close_avg", "volatility")


# ---------------------------------------------------------------- the stored vector index


def _searched(spark, sf, path):
    e = B.table(spark, sf, "embeddings")
    return _index.search_index(spark, path, row_queries(e), 10, out_id="vec_id")


@register("vector_index_search")
def vector_index_search(spark, sf):
    """The rows with an id divisible by 20 against a stored index of all rows."""
    path = scratch_path(spark, "vector-index")
    _index.build_index(B.table(spark, sf, "embeddings"), path, "vec_id")
    return _searched(spark, sf, path)[0].select("qid", "rank", "vec_id", "similarity")


@register("vector_index_recall")
def vector_index_recall(spark, sf):
    """What that search finds of the exact one, and the share of all pairs that it
    estimates by codes and scores."""
    path = scratch_path(spark, "vector-index")
    _index.build_index(B.table(spark, sf, "embeddings"), path, "vec_id")
    hits, cost = _searched(spark, sf, path)
    exact = vector_topk_rows(spark, sf)
    mean = lambda c: round_half_up(F.avg(c), 4)
    got = _vec.recall_at_k(hits, exact, "qid", "vec_id").agg(F.count(F.lit(1)).alias("queries"), mean("recall").alias("mean_recall"))
    shares = cost.agg(mean(F.col("estimated") / F.col("rows")).alias("share_estimated"), mean(F.col("scored") / F.col("rows")).alias("share_scored"))
    return got.select("queries", "mean_recall", shares.select("share_estimated").scalar().alias("share_estimated"),
                      shares.select("share_scored").scalar().alias("share_scored"))


@register("vector_index_upkeep")
def vector_index_upkeep(spark, sf):
    """An index of rows that lack every tenth and hold every seventh turned round,
    after an update by the right ones: each row once, in one cell, with its vector."""
    e = B.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    stale = (F.col("vec_id") % 7 == 3)
    path = scratch_path(spark, "vector-index")
    _index.build_index(e.where("vec_id % 10 <> 0").withColumn("embedding", F.when(stale, F.reverse("embedding")).otherwise(F.col("embedding"))), path, "vec_id")
    _index.update_index(spark, path, e.where((F.col("vec_id") % 10 == 0) | stale), "vec_id")
    cells = spark.read.parquet(f"{path}/cells")
    places = spark.read.parquet(f"{path}/places").select("id", F.col("cell").alias("_place"))
    return (cells.join(places, "id").groupBy(F.col("id").alias("vec_id"))
            .agg(F.count(F.lit(1)).alias("n"), F.every(F.col("cell") == F.col("_place")).alias("in_place"),
                 F.max(F.element_at("vec", 1)).alias("first"), F.max(F.element_at("vec", -1)).alias("last")))


# ---------------------------------------------------------------- results merged from partial states


def _states(spark, sf):
    """States of the quotes, each brand of ``part`` as a file of its own, as a table."""
    quotes = B.quotes(spark, sf).withColumn("source_file", F.col("sector"))
    return {k: materialize(df, f"state-{k}") for k, df in _state.partial_states(quotes, ["source_file"], sector="sector").items()}


@register("market_summary_merged")
def market_summary_merged(spark, sf):
    return _state.merged_results(_states(spark, sf), by=[], sector="sector")["market_summary"]


@register("sector_stats_merged")
def sector_stats_merged(spark, sf):
    return _state.merged_results(_states(spark, sf), by=[], sector="sector")["sector_stats"]


@register("concentration_merged")
def concentration_merged(spark, sf):
    return _state.merged_results(_states(spark, sf), by=[], sector="sector")["concentration"]


@register("top_gainers_merged")
def top_gainers_merged(spark, sf):
    return _state.merged_results(_states(spark, sf), by=[], sector="sector")["top_gainers"]


# ---------------------------------------------------------------- the snapshot by value, the other answers, the whole answer


_SCALARS = {"spot_summary": ("up_count", "down_count", "flat_count", "total_count", "avg_change_pct", "std_change_pct", "total_amount"),
            "pe": ("current", "max", "min", "mean", "percentile"), "concentration": ("top10_pct", "top50_pct"),
            "index_stats": ("close_min", "close_max", "close_avg", "volatility", "close", "avg_change_pct")}
_LISTS = {"top_gainers": ("code", "change_pct"), "top_losers": ("code", "change_pct"), "top_amount": ("code", "amount"), "sector_stats": ("sector", "avg_change")}


@register("market_snapshot_values")
def market_snapshot_values(spark, sf):
    """Every value of the snapshot as a row: piece, place in its list (0 outside lists), name, value."""
    s = materialize(_snapshot(spark, sf), "snapshot")
    row = lambda piece, place, name, value: F.struct(F.lit(piece).alias("piece"), place.cast("int").alias("place"), name.cast("string").alias("name"),
                                                     value.cast("double").alias("value"))
    single = F.array(*[row(p, F.lit(0), F.lit(f), F.col(f"{p}.{f}")) for p, fields in _SCALARS.items() for f in fields])

    def listed(piece, name, value):
        return F.transform(piece, lambda x, i: row(piece, i + 1, x[name], x[value]))

    lists = [listed(p, *fields) for p, fields in _LISTS.items()]
    return s.select(F.inline(F.concat(single, *lists)))


def _quoted(text):
    """A text column as a JSON string."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r"(?s)^\{\"t\":(.*)\}$", 1)


@register("structured_parse_macro")
def structured_parse_macro(spark, sf):
    """Macro answers with nested objects: prose, a missing field inside one, a
    fraction where a count is asked for, a percentile out of range."""
    c, n = B.table(spark, sf, "conversations"), F.length("text")
    num = lambda x: x.cast("string")
    pe = F.concat(F.lit('{"current_pe": '), num(n / F.lit(8.0)), F.lit(', "historical_max": "50", "historical_min": 5, "historical_mean": 20.5, "percentile": '),
                  num(n % 130), F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(', "assessment": '), _quoted(F.col("role")))), F.lit("}"))
    breadth = F.concat(F.lit('{"up_count": '), num(n), F.lit(', "down_count": '), F.when(n % 3 == 0, F.lit("1.5")).otherwise(F.lit('"12"')),
                       F.lit(', "flat_count": 0, "avg_change_pct": -0.5, "breadth_signal": '), _quoted(F.col("text")), F.lit("}"))
    obj = F.concat(F.lit('{"pe_valuation": '), pe, F.lit(', "market_breadth": '), breadth,
                   F.lit(', "economic_events": [], "sentiment": "s", "key_drivers": ["a"], "confidence": 1}'))
    raw = F.when(n % 11 == 0, F.col("text")).otherwise(obj)
    parsed = _struct.parse_structured(c.select("conv_id", "turn", raw.alias("raw")), "raw", "macro")
    return parsed.select("conv_id", "turn", "status", F.col("parsed.pe_valuation.current_pe").alias("current_pe"), F.col("parsed.market_breadth.up_count").alias("up_count"),
                         F.length("parsed.market_breadth.breadth_signal").cast("long").alias("n_signal"))


@register("structured_parse_fund_flow")
def structured_parse_fund_flow(spark, sf):
    """Fund-flow answers with lists of objects: prose, a missing direction, an
    object of a list without its amount, a confidence out of range."""
    c, n = B.table(spark, sf, "conversations"), F.length("text")
    amount = F.when(n % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(', "amount": '), (n * F.lit(2.0)).cast("string")))
    stocks = F.concat(F.lit('[{"code": "1", "name": "n", "amount": 1, "change_pct": 0}, {"code": '), _quoted(F.col("role")), F.lit(', "name": '), _quoted(F.col("text")),
                      amount, F.lit(', "change_pct": "1.5"}]'))
    obj = F.concat(F.lit('{"top_turnover_stocks": '), stocks, F.lit(', "sector_rotation": []'), F.when(n % 7 == 0, F.lit("")).otherwise(F.lit(', "capital_direction": "in"')),
                   F.lit(', "concentration_note": "c", "confidence": '), (n / F.lit(500.0)).cast("string"), F.lit("}"))
    raw = F.when(n % 11 == 0, F.col("text")).otherwise(F.concat(F.lit("Answer:\n```json\n"), obj, F.lit("\n```\n")))
    parsed = _struct.parse_structured(c.select("conv_id", "turn", raw.alias("raw")), "raw", "fund_flow")
    last = F.col("parsed.top_turnover_stocks")[1]
    return parsed.select("conv_id", "turn", "status", last["amount"].alias("amount"), F.length(last["name"]).cast("long").alias("n_name"))


@register("structured_parse_editor")
def structured_parse_editor(spark, sf):
    """Editor's reports, fenced or not: prose, missing highlights, a section without content."""
    c, n = B.table(spark, sf, "conversations"), F.length("text")
    content = F.when(n % 5 == 0, F.lit("null")).otherwise(_quoted(F.col("text")))
    obj = F.concat(F.lit('{"report_date": "2024-01-02", "summary": '), _quoted(F.col("text")), F.lit(', "sections": [{"heading": "h", "content": '), content,
                   F.lit(', "source_agent": '), _quoted(F.col("role")), F.lit('}], "overall_sentiment": "s", "risk_level": "low"'),
                   F.when(n % 7 == 0, F.lit("")).otherwise(F.lit(', "key_highlights": ["a", "b"]')), F.lit(', "contradictions_resolved": []}'))
    fenced = F.concat(F.lit("{}\n```json\n"), obj, F.lit("\n```"))
    raw = F.when(n % 11 == 0, F.col("text")).when(n % 2 == 0, fenced).otherwise(obj)
    parsed = _struct.parse_structured(c.select("conv_id", "turn", raw.alias("raw")), "raw", "editor", fence_first=True)
    return parsed.select("conv_id", "turn", "status", F.size("parsed.key_highlights").alias("n_highlights"), F.length(F.col("parsed.sections")[0]["content"]).cast("long").alias("n_content"))


@register("render_whole_answer")
def render_whole_answer(spark, sf):
    """A conversation's answer: its first turn as the question, two analysts of
    whom one fails in every third, its report (none in every fourth) and its context."""
    rep, ctx = _conversation_reports(spark, sf), render_context(spark, sf)
    brief = F.when(F.col("conv_id") % 3 != 0, F.lit("in"))
    rows = F.array(_render.answer_row(_render.display_name("fund_flow"), brief, F.lit(0.625)), _render.answer_row(_render.display_name("risk"), F.lit("r"), F.lit(0.5)))
    final = F.when(F.col("conv_id") % 4 != 0, F.struct("overall_sentiment", "risk_level", "summary", "sections", "key_highlights"))
    return rep.join(ctx, "conv_id", "left").select("conv_id", _render.render_answer(F.col("summary"), rows, final, F.col("context")).alias("answer"))


@register("embed_changed_only")
def embed_changed_only(spark, sf):
    """``embed_hash`` through a store of vectors: most documents first, then all,
    of which only texts that the store lacks are embedded."""
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    path = scratch_path(spark, "vectors-by-content")
    embed = lambda df, c: _embed.hash_embed(df, c, dims=256)
    _embed.embed_changed(d.where("doc_id % 10 <> 0"), "text", path, embed)
    return _embed.embed_changed(d, "text", path, embed).select("doc_id", "embedding")
