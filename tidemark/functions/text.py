"""Text column helpers (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import ColumnOrName, col

# Fixed values that must equal the reference's behaviour.
# First fenced code block, optional "json" tag, dot matches newline, non-greedy.
FENCE_PATTERN = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
# Words whose presence marks a report as citing news.
NEWS_KEYWORDS = ["新闻", "报道", "消息", "RAG"]
# Sentence produced when retrieval returns nothing.
NO_HITS_TEXT = "（暂无相关新闻）"
# Minimum article text length kept in the knowledge base.
MIN_ARTICLE_CHARS = 20
# Metadata title length.
META_TITLE_CHARS = 200
# Context excerpt length per hit.
CONTEXT_EXCERPT_CHARS = 300
# Length of the raw-text head kept with a parse failure.
REJECT_HEAD_CHARS = 500


def md5_id(c: ColumnOrName) -> Column:
    """Hex md5 of the UTF-8 text (document id)."""
    return F.md5(col(c).cast("string"))


def head(c: ColumnOrName, n: int) -> Column:
    """First n characters (code points)."""
    return F.substring(col(c), 1, n)


def blank_to_null(c: ColumnOrName) -> Column:
    x = col(c)
    return F.when(F.trim(x) == "", F.lit(None).cast("string")).otherwise(x)


def fence_body(c: ColumnOrName) -> Column:
    """Group 1 of the first fenced block, trimmed; null when there is none."""
    raw = col(c)
    body = F.regexp_extract(raw, FENCE_PATTERN, 1)
    has = raw.rlike(r"(?s)```(?:json)?\s*\n?.*?\n?```")
    return F.when(has, strip(body))


def strip(c: ColumnOrName) -> Column:
    """Remove leading/trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def contains_any(c: ColumnOrName, words: list[str]) -> Column:
    """True when any of the words occurs (plain substring match)."""
    x = col(c)
    out = F.lit(False)
    for w in words:
        out = out | F.coalesce(F.contains(x, F.lit(w)), F.lit(False))
    return out


def fmt_pct0(c: ColumnOrName) -> Column:
    """A ratio as an integer percent, half-up (0.825 -> '83%')."""
    return F.concat(F.format_string("%.0f", F.round(col(c).cast("decimal(38,8)") * 100, 0).cast("double")), F.lit("%"))


def fmt_fixed(c: ColumnOrName, digits: int) -> Column:
    """Fixed-point text with half-up rounding on a DECIMAL."""
    return F.format_string(f"%.{digits}f", F.round(col(c).cast("decimal(38,8)"), digits).cast("double"))
