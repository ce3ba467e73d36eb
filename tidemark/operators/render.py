"""Text rendering as column expressions.

Every renderer turns rows (one per date / question / report) into text with
``format_string``, ``transform`` and ``array_join``; nothing is formatted on
the driver.  Lists inside a row (top stocks, hits, sections) are bounded by
the producer (top-n, k hits, a report's sections).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CONTEXT_EXCERPT_CHARS, NO_HITS_TEXT, fmt_fixed, fmt_pct0, head

# ---------------------------------------------------------------- fixed values
# Text templates that must read exactly like the reference's output.
NA = "N/A"
MACRO_TEMPLATE = (
    "\nPE 估值数据：\n  当前 PE: {current}\n  历史最高: {max}\n  历史最低: {min}\n  历史均值: {mean}\n"
    "  当前分位数: {percentile}%\n\n市场广度数据：\n  上涨: {up} 只\n  下跌: {down} 只\n  平盘: {flat} 只\n"
    "  平均涨跌幅: {avg}%\n"
)
TECHNICAL_TEMPLATE = (
    "\n沪深300 指数数据：\n  收盘价: {close}\n  区间最低: {close_min}\n  区间最高: {close_max}\n"
    "  区间平均涨跌幅: {avg_change}%\n\n市场整体涨跌幅分布标准差: {std}\n"
)
FUND_FLOW_TEMPLATE = (
    "\n成交额 TOP 10 个股：\n{stocks}\n\n板块资金流向：\n{sectors}\n\n成交集中度：\n"
    "  Top10 成交额占比: {top10}%\n  Top50 成交额占比: {top50}%\n"
)
FUND_FLOW_STOCK_LINE = "  {code} {name} 成交额{amount}元 涨跌幅{change}%"
FUND_FLOW_SECTOR_LINE = "  {sector} 平均涨跌幅{avg}% 总成交额{amount}元"
RISK_TEMPLATE = (
    "\n风险相关数据：\n  全市场涨跌幅标准差: {std}\n  成交集中度 Top10: {top10}%\n  成交集中度 Top50: {top50}%\n\n"
    "跌幅超 5% 个股数: {n} 只\n跌幅前 5:\n{stocks}\n"
)
RISK_STOCK_LINE = "  {code} {name} 跌幅 {change}%"
RISK_NONE = "  (无)"
CONTEXT_HEADER = "以下是通过 RAG 检索到的 {n} 条相关财经新闻：\n"
CONTEXT_HIT = "---\n【{i}】{title}\n来源: {source} | 日期: {date} | 相关度: {sim}\n{excerpt}"
CONTEXT_DEFAULTS = {"title": "无标题", "source": "?", "date": "?"}
QUERY_TEMPLATE = "今日A股市场概况：\n上涨 {up} 家，下跌 {down} 家\n平均涨跌幅 {avg}%\n\n涨幅前列: {gainers}\n成交额前列: {amounts}"
NAME_SEPARATOR = "、"
ANALYST_PROMPT = "## 今日市场数据\n{focus}\n\n## 相关新闻（RAG 检索）\n{context}\n\n## 输出要求\n必须严格输出以下 JSON Schema 定义的 JSON 对象，不要输出任何其他内容：\n{schema}"
REPORT_TITLE = "# A股市场日报 ({date})"
REPORT_JUDGEMENT = "> **综合判断**: {sentiment} | **风险等级**: {risk}"
REPORT_SUMMARY_HEADING = "## 摘要"
REPORT_SECTION_NOTE = "*({agent} 提供)*"
REPORT_HIGHLIGHTS_HEADING = "## 关键要点"
REPORT_DISAGREEMENT_HEADING = "## 分析师分歧说明"
REPORT_RULE = "---"
REPORT_FOOTER = "*报告由多智能体系统自动生成*"
AGENT_DISPLAY = {
    "macro": "🏛️ 宏观分析师",
    "technical": "📈 技术分析师",
    "fund_flow": "💰 资金面分析师",
    "risk": "⚠️ 风险分析师",
}
ANSWER_FAILED = "❌ 分析失败"
ANSWER_ROW = "| {display} | {brief} | {conf} |"
ANSWER_HEAD = "## 🤖 多智能体分析\n\n**你的问题**: {question}\n\n### 各分析师观点\n\n| 分析师 | 核心观点 | 置信度 |\n|--------|---------|--------|"
ANSWER_SYNTHESIS = "### 📝 综合研判\n"
ANSWER_NO_SYNTHESIS = "（主编汇总失败）"
ANSWER_JUDGEMENT = "**市场情绪**: {sentiment}\n**风险等级**: {risk}\n"
ANSWER_HIGHLIGHTS = "**关键要点**:"
ANSWER_NEWS = "\n---\n\n### 📎 参考新闻 (RAG 检索)"
NEWS_SEPARATOR, NEWS_PARTS = "---", 3
SCORE_TABLE = ("\n## 质量评估\n\n| 指标 | 得分 |\n|------|------|\n| 检索精度 | {retrieval} |\n| Agent 一致性 | {consistency} |\n"
               "| 报告质量 | {passed} |\n| **综合评分** | **{overall}** |\n")
SCORE_PASS, SCORE_FAIL = "通过", "未通过"
EDITOR_PROMPT = "## 报告日期\n{date}\n\n## 原始市场数据摘要\n{brief}\n\n## RAG 检索到的新闻\n{context}\n\n{reports}\n\n{task}"
EDITOR_REPORT = "## {name}报告 (置信度: {conf})\n```json\n{json}\n```"
EDITOR_NAMES = {"macro": "宏观分析师", "technical": "技术分析师", "fund_flow": "资金面分析师", "risk": "风险分析师"}
MARKET_BRIEF = "上涨 {up} 家 / 下跌 {down} 家，平均涨跌幅 {avg}%"
EDITOR_TASK = "请综合以上所有信息，输出最终日报 JSON。"
EDITOR_QUESTION = "## 用户问题\n{question}\n\n请围绕以上问题，综合以下信息给出回答（JSON 格式）。"


# ---------------------------------------------------------------- helpers


def _fmt(template: str, **parts: Column) -> Column:
    """Fill a {name} template with column values (text as-is, no escaping)."""
    pieces: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            pieces.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            pieces.append(F.lit(rest[:i]))
        pieces.append(parts[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*pieces) if pieces else F.lit("")


def text_or_na(c: Column) -> Column:
    """Python-like str() of a value, 'N/A' when missing."""
    return F.coalesce(c.cast("string"), F.lit(NA))


# ---------------------------------------------------------------- C1 focus text


def focus_macro(pe: Column, spot: Column) -> Column:
    return _fmt(MACRO_TEMPLATE,
                current=text_or_na(pe["current"]), max=text_or_na(pe["max"]), min=text_or_na(pe["min"]),
                mean=text_or_na(pe["mean"]), percentile=text_or_na(pe["percentile"]),
                up=text_or_na(spot["up_count"]), down=text_or_na(spot["down_count"]),
                flat=text_or_na(spot["flat_count"]), avg=text_or_na(spot["avg_change_pct"]))


def focus_technical(index: Column, spot: Column) -> Column:
    return _fmt(TECHNICAL_TEMPLATE,
                close=text_or_na(index["close"]), close_min=text_or_na(index["close_min"]),
                close_max=text_or_na(index["close_max"]), avg_change=text_or_na(index["avg_change_pct"]),
                std=text_or_na(spot["std_change_pct"]))


def _lines(arr: Column, line) -> Column:
    return F.array_join(F.transform(F.coalesce(arr, F.array()), line), "\n")


def focus_fund_flow(top_amount: Column, sectors: Column, conc: Column) -> Column:
    stock = lambda s: _fmt(FUND_FLOW_STOCK_LINE, code=F.coalesce(s["code"].cast("string"), F.lit("?")),
                           name=F.coalesce(s["name"], F.lit("?")),
                           amount=fmt_fixed(F.coalesce(s["amount"], F.lit(0.0)), 0),
                           change=fmt_fixed(F.coalesce(s["change_pct"], F.lit(0.0)), 2))
    sector = lambda s: _fmt(FUND_FLOW_SECTOR_LINE, sector=F.coalesce(s["sector"], F.lit("?")),
                            avg=fmt_fixed(F.coalesce(s["avg_change"], F.lit(0.0)), 2),
                            amount=fmt_fixed(F.coalesce(s["total_amount"], F.lit(0.0)), 0))
    return _fmt(FUND_FLOW_TEMPLATE,
                stocks=_lines(F.slice(top_amount, 1, 10), stock),
                sectors=_lines(F.slice(sectors, 1, 8), sector),
                top10=text_or_na(conc["top10_pct"]), top50=text_or_na(conc["top50_pct"]))


def focus_risk(spot: Column, conc: Column, top_losers: Column, threshold: float = 5.0) -> Column:
    big = F.filter(F.coalesce(top_losers, F.array()), lambda s: F.abs(F.coalesce(s["change_pct"], F.lit(0.0))) > threshold)
    stock = lambda s: _fmt(RISK_STOCK_LINE, code=F.coalesce(s["code"].cast("string"), F.lit("?")),
                           name=F.coalesce(s["name"], F.lit("?")),
                           change=fmt_fixed(F.coalesce(s["change_pct"], F.lit(0.0)), 2))
    listing = F.when(F.size(big) == 0, F.lit(RISK_NONE)).otherwise(_lines(F.slice(big, 1, 5), stock))
    return _fmt(RISK_TEMPLATE, std=text_or_na(spot["std_change_pct"]),
                top10=text_or_na(conc["top10_pct"]), top50=text_or_na(conc["top50_pct"]),
                n=F.size(big).cast("string"), stocks=listing)


def focus_texts(snapshot: DataFrame, key: list[str]) -> DataFrame:
    """(key..., analyst, focus) for the four analysts, from a snapshot table."""
    s = snapshot
    kinds = F.array(
        F.struct(F.lit("macro").alias("analyst"), focus_macro(s["pe"], s["spot_summary"]).alias("focus")),
        F.struct(F.lit("technical").alias("analyst"), focus_technical(s["index_stats"], s["spot_summary"]).alias("focus")),
        F.struct(F.lit("fund_flow").alias("analyst"),
                 focus_fund_flow(s["top_amount"], s["sector_stats"], s["concentration"]).alias("focus")),
        F.struct(F.lit("risk").alias("analyst"),
                 focus_risk(s["spot_summary"], s["concentration"], s["top_losers"]).alias("focus")),
    )
    return s.select(*key, F.inline(kinds))


# ---------------------------------------------------------------- C2 / C3 prompts


def search_query(spot: Column, gainers: Column, amounts: Column) -> Column:
    names = lambda arr: F.array_join(F.transform(F.slice(F.coalesce(arr, F.array()), 1, 5),
                                                  lambda s: F.coalesce(s["name"], F.lit(""))), NAME_SEPARATOR)
    return _fmt(QUERY_TEMPLATE, up=F.coalesce(spot["up_count"].cast("string"), F.lit("?")),
             down=F.coalesce(spot["down_count"].cast("string"), F.lit("?")),
             avg=F.coalesce(spot["avg_change_pct"].cast("string"), F.lit("?")),
             gainers=names(gainers), amounts=names(amounts))


def analyst_prompt(focus: Column, context: Column, schema_text: Column) -> Column:
    return _fmt(ANALYST_PROMPT, focus=focus, context=F.coalesce(context, F.lit("")), schema=schema_text)


# ---------------------------------------------------------------- C9 context


def render_context(hits: DataFrame, key: list[str], rank: str = "rank", title: str = "title",
                   source: str = "source", date: str = "date", similarity: str = "similarity",
                   document: str = "document") -> DataFrame:
    """One context text per key from its ranked hits (at most k rows per key)."""
    line = _fmt(CONTEXT_HIT, i=F.col(rank).cast("string"),
                title=F.coalesce(F.col(title), F.lit(CONTEXT_DEFAULTS["title"])),
                source=F.coalesce(F.col(source), F.lit(CONTEXT_DEFAULTS["source"])),
                date=F.coalesce(F.col(date), F.lit(CONTEXT_DEFAULTS["date"])),
                sim=fmt_pct0(F.col(similarity)),
                excerpt=head(F.coalesce(F.col(document), F.lit("")), CONTEXT_EXCERPT_CHARS))
    g = hits.groupBy(*key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("t")))).alias("_l"),
    )
    body = F.array_join(F.transform("_l", lambda s: s["t"]), "\n")
    header = _fmt(CONTEXT_HEADER, n=F.col("_n").cast("string"))
    return g.select(*key, F.concat(header, F.lit("\n"), body).alias("context"))


def context_or_none(context: Column) -> Column:
    """The fixed sentence for a query without hits."""
    return F.coalesce(context, F.lit(NO_HITS_TEXT))


# ---------------------------------------------------------------- C13 report


def render_report(report_date: Column, summary: Column, sections: Column, sentiment: Column,
                  risk: Column, highlights: Column, contradictions: Column,
                  footer: str = REPORT_FOOTER, card: Column | None = None) -> Column:
    """Markdown of a report row; the disagreement block only when non-empty, the
    score table only with an evaluation ``card`` (see ``evaluate.eval_card``)."""
    sec = lambda s: F.concat_ws("\n", F.concat(F.lit("## "), s["heading"]), F.lit(""), s["content"], F.lit(""),
                                _fmt(REPORT_SECTION_NOTE, agent=s["source_agent"]), F.lit(""))
    bullets = lambda arr: F.array_join(F.transform(F.coalesce(arr, F.array()), lambda h: F.concat(F.lit("- "), h)), "\n")
    sections_md = F.array_join(F.transform(F.coalesce(sections, F.array()), sec), "\n")
    has_c = F.size(F.coalesce(contradictions, F.array())) > 0
    disagreement = F.when(has_c, F.concat_ws("\n", F.lit(REPORT_DISAGREEMENT_HEADING), F.lit(""),
                                             bullets(contradictions), F.lit("")))
    has_h = F.size(F.coalesce(highlights, F.array())) > 0
    parts = [
        _fmt(REPORT_TITLE, date=report_date), F.lit(""),
        _fmt(REPORT_JUDGEMENT, sentiment=sentiment, risk=risk), F.lit(""),
        F.lit(REPORT_SUMMARY_HEADING), F.lit(""), summary, F.lit(""),
        F.when(F.size(F.coalesce(sections, F.array())) > 0, sections_md),
        F.lit(REPORT_HIGHLIGHTS_HEADING), F.lit(""),
        F.when(has_h, bullets(highlights)), F.lit(""),
        disagreement,
        F.lit(REPORT_RULE), *([] if card is None else [F.when(card.isNotNull(), score_table(card))]), F.lit(footer),
    ]
    return F.concat_ws("\n", *parts)


def score_table(card: Column) -> Column:
    """The four scores of an evaluation card; a missing score counts as 0."""
    share = lambda c: fmt_pct0(F.coalesce(c, F.lit(0.0)))
    passed = F.when(F.coalesce(card["report_quality"]["pass"], F.lit(False)), F.lit(SCORE_PASS)).otherwise(F.lit(SCORE_FAIL))
    return _fmt(SCORE_TABLE, retrieval=share(card["retrieval_precision"]), consistency=share(card["cross_agent_consistency"]),
                passed=passed, overall=share(card["overall_score"]))


# ---------------------------------------------------------------- C2 editor prompt


def editor_prompt(date: Column, spot: Column, context: Column, results: dict[str, Column], question: Column | None = None) -> Column:
    """The editor's input: market brief, news, the four reports as JSON with
    their confidences, and the task, or the user's question where there is one."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    brief = _fmt(MARKET_BRIEF, up=text(spot["up_count"]), down=text(spot["down_count"]), avg=text(spot["avg_change_pct"]))
    reports = F.concat_ws("\n\n", *[
        _fmt(EDITOR_REPORT, name=F.lit(EDITOR_NAMES[k]), conf=F.coalesce(r["confidence"].cast("string"), F.lit("")), json=F.coalesce(F.to_json(r), F.lit("null")))
        for k, r in results.items()])
    task = F.lit(EDITOR_TASK)
    if question is not None:
        asked = F.coalesce(question, F.lit("")) != ""
        task = F.when(asked, _fmt(EDITOR_QUESTION, question=F.coalesce(question, F.lit("")))).otherwise(task)
    return _fmt(EDITOR_PROMPT, date=date, brief=brief, context=F.coalesce(context, F.lit("")), reports=reports, task=task)


# ---------------------------------------------------------------- C14 answer, F16


def news_excerpt(context: Column) -> Column:
    """The first parts of a context text between its separators (F16)."""
    return F.array_join(F.slice(F.split(context, NEWS_SEPARATOR), 1, NEWS_PARTS), "\n")


def render_answer(question: Column, rows: Column, final: Column, context: Column) -> Column:
    """The whole answer: head, one table row per analyst (``rows``: an array of
    lines), the editor's synthesis (``final``: a report struct, null where it
    failed) and the news it leans on."""
    part = lambda s: F.concat_ws("\n", F.concat(F.lit("**"), s["heading"], F.lit("**")), s["content"], F.lit(""))
    sections, highlights = F.coalesce(final["sections"], F.array()), F.coalesce(final["key_highlights"], F.array())
    synthesis = F.concat_ws(
        "\n", _fmt(ANSWER_JUDGEMENT, sentiment=final["overall_sentiment"], risk=final["risk_level"]), final["summary"], F.lit(""),
        F.when(F.size(sections) > 0, F.array_join(F.transform(sections, part), "\n")),
        F.when(F.size(highlights) > 0, F.concat_ws("\n", F.lit(ANSWER_HIGHLIGHTS), F.array_join(F.transform(highlights, lambda h: F.concat(F.lit("- "), h)), "\n"))))
    news = F.when(F.trim(F.coalesce(context, F.lit(""))) != "", F.concat_ws("\n", F.lit(ANSWER_NEWS), news_excerpt(context)))
    return F.concat_ws("\n", _fmt(ANSWER_HEAD, question=F.coalesce(question, F.lit(""))), F.array_join(rows, "\n"), F.lit(""), F.lit(ANSWER_SYNTHESIS),
                       F.when(final.isNull(), F.lit(ANSWER_NO_SYNTHESIS)).otherwise(synthesis), news)


# ---------------------------------------------------------------- C14 answer rows


def analyst_brief(kind: str, result: Column) -> Column:
    """One-line brief of one analyst's result (each kind has its own struct)."""
    if kind == "macro":
        return F.concat(result["sentiment"], F.lit("，PE分位"),
                        result["pe_valuation"]["percentile"].cast("string"), F.lit("%"))
    if kind == "technical":
        return F.concat(result["trend"], F.lit("（"), result["trend_strength"], F.lit("），"),
                        head(result["index_summary"], 30))
    if kind == "fund_flow":
        return result["capital_direction"]
    if kind == "risk":
        return F.concat(F.lit("风险"), result["overall_risk_level"], F.lit("，脆弱度"), fmt_pct0(result["fragility_score"]))
    return F.lit("—")


def answer_row(display: Column, brief: Column, confidence: Column) -> Column:
    """A table line of the answer; a failed analyst (null brief) shows the failure mark."""
    ok = _fmt(ANSWER_ROW, display=display, brief=brief, conf=fmt_pct0(confidence))
    bad = _fmt(ANSWER_ROW, display=display, brief=F.lit(ANSWER_FAILED), conf=F.lit("-"))
    return F.when(brief.isNull(), bad).otherwise(ok)


def display_name(kind: str) -> Column:
    return F.lit(AGENT_DISPLAY.get(kind, kind))


def answer_rows(gathered: DataFrame, key: list[str], kinds: list[str] = list(AGENT_DISPLAY)) -> DataFrame:
    """(key..., analyst, line) table rows for a gathered result table (one
    column per analyst, null where it failed)."""
    rows = F.array(*[
        F.struct(F.lit(k).alias("analyst"),
                 answer_row(display_name(k), analyst_brief(k, F.col(k)), F.col(k)["confidence"]).alias("line"))
        for k in kinds
    ])
    return gathered.select(*key, F.inline(rows))
