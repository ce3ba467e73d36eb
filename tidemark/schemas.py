"""Table and structured-output schemas (DDL strings)."""

from __future__ import annotations

# Landing schemas.  Numeric quote fields are landed as text and coerced later.
QUOTE_FIELDS = [
    "code", "name", "price", "change_amt", "change_pct", "bid", "ask",
    "prev_close", "open", "high", "low", "volume", "amount", "ts",
]
QUOTES_RAW = ", ".join(f"{c} string" for c in QUOTE_FIELDS)
BARS = "date date, open double, close double, high double, low double, volume double, amount double"
VALUATION = "date date, index_val double, avg_pe double"
SECTOR_MAP = "code string, name string, industry string"
BOARDS_NESTED = "industry string, constituents array<struct<code: string, name: string>>"
NEWS = (
    "title string, content string, publish_time string, source string, "
    "stock_code string, url string, crawl_date string"
)
NEWS_WITH_CORRUPT = NEWS + ", _corrupt_record string"
KNOWLEDGE_BASE = (
    "id string, embedding array<float>, document string, "
    "metadata struct<title: string, source: string, date: string, url: string>, batch_date string"
)

# Result tables with typed empty forms.
SECTOR_STATS = "industry_name string, stock_count bigint, avg_change double, total_amount double"

# Structured outputs of the four analysts and the editor.
MACRO = (
    "pe_valuation struct<current_pe: double, historical_max: double, historical_min: double, "
    "historical_mean: double, percentile: double, assessment: string>, "
    "market_breadth struct<up_count: bigint, down_count: bigint, flat_count: bigint, "
    "avg_change_pct: double, breadth_signal: string>, "
    "economic_events array<string>, sentiment string, key_drivers array<string>, confidence double"
)
TECHNICAL = (
    "trend string, trend_strength string, support_level double, resistance_level double, "
    "index_summary string, momentum_signals array<string>, confidence double"
)
FUND_FLOW = (
    "top_turnover_stocks array<struct<code: string, name: string, amount: double, change_pct: double>>, "
    "sector_rotation array<struct<sector_name: string, avg_change_pct: double, total_amount: double, direction: string>>, "
    "capital_direction string, concentration_note string, confidence double"
)
RISK = (
    "concentration_risk string, volatility_assessment string, external_risks array<string>, "
    "stock_warnings array<string>, fragility_score double, overall_risk_level string, confidence double"
)
REPORT = (
    "report_date string, summary string, "
    "sections array<struct<heading: string, content: string, source_agent: string>>, "
    "overall_sentiment string, risk_level string, key_highlights array<string>, "
    "contradictions_resolved array<string>"
)

ANALYST_SCHEMAS = {"macro": MACRO, "technical": TECHNICAL, "fund_flow": FUND_FLOW, "risk": RISK}
ANALYSTS = ["macro", "technical", "fund_flow", "risk"]


def json_schema(ddl: str, optional: frozenset[str] | set[str] = frozenset()) -> str:
    """A DDL schema (string, double, bigint, boolean, array, struct) as JSON
    Schema text, for prompts that ask for such an object."""
    import json
    import re

    plain = {"string": "string", "double": "number", "bigint": "integer", "boolean": "boolean"}
    words = re.findall(r"\w+|[<>]", ddl)

    def of() -> dict:
        word = words.pop(0)
        if word in plain:
            return {"type": plain[word]}
        words.pop(0)  # <
        out = {"type": "array", "items": of()} if word == "array" else obj(frozenset())
        words.pop(0)  # >
        return out

    def obj(maybe) -> dict:
        fields = {}
        while words and words[0] != ">":
            name, kind = words.pop(0), of()
            fields[name] = {"anyOf": [kind, {"type": "null"}]} if name in maybe else kind
        return {"type": "object", "properties": fields, "required": [n for n in fields if n not in maybe]}

    return json.dumps(obj(optional), ensure_ascii=False, indent=2)
