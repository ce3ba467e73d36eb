"""Rule-based report quality, judge-score parsing and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_up
from ..functions.text import NEWS_KEYWORDS, NO_HITS_TEXT, contains_any

# Quality thresholds and score weights.
MIN_WORDS = 400
MAX_WORDS = 1000
MIN_SECTIONS = 4
MIN_HIGHLIGHTS = 3
JUDGE_DEFAULT = 0.5
WEIGHT_RETRIEVAL = 0.25
WEIGHT_CONSISTENCY = 0.25
WEIGHT_QUALITY = 0.5
QUALITY_FAIL_CREDIT = 0.5


def report_quality(sections: Column, highlights: Column, contradictions: Column,
                   min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
                   min_sections: int = MIN_SECTIONS, min_highlights: int = MIN_HIGHLIGHTS,
                   keywords: list[str] = NEWS_KEYWORDS) -> Column:
    """Struct(word_count, section_count, has_highlights, has_contradictions,
    cites_news, pass).  word_count counts characters of the section bodies,
    one newline each, like the reference."""
    secs = F.coalesce(sections, F.array())
    body = F.array_join(F.transform(secs, lambda s: F.concat(F.coalesce(s["content"], F.lit("")), F.lit("\n"))), "")
    wc = F.aggregate(secs, F.lit(0).cast("long"),
                     lambda acc, s: acc + F.length(F.coalesce(s["content"], F.lit(""))).cast("long") + 1)
    sc = F.size(secs).cast("long")
    hl = F.size(F.coalesce(highlights, F.array())) >= min_highlights
    return F.struct(
        wc.alias("word_count"),
        sc.alias("section_count"),
        hl.alias("has_highlights"),
        (F.size(F.coalesce(contradictions, F.array())) > 0).alias("has_contradictions"),
        contains_any(body, keywords).alias("cites_news"),
        (wc.between(min_words, max_words) & (sc >= min_sections) & hl).alias("pass"),
    )


def report_quality_rows(sections: DataFrame, key: list[str], content: str = "content",
                        is_highlight: Column | None = None, is_contradiction: Column | None = None,
                        min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
                        min_sections: int = MIN_SECTIONS, min_highlights: int = MIN_HIGHLIGHTS,
                        keywords: list[str] = NEWS_KEYWORDS) -> DataFrame:
    """The same checks over one row per section (long form), as plain
    aggregates: nothing is collected per report, so report size is not bounded
    by task memory.  Highlights / disagreements are flagged rows."""
    hl = is_highlight if is_highlight is not None else F.lit(False)
    ct = is_contradiction if is_contradiction is not None else F.lit(False)
    c = F.coalesce(F.col(content), F.lit(""))
    g = sections.groupBy(*key).agg(
        F.sum(F.length(c) + 1).cast("long").alias("word_count"),
        F.count(F.lit(1)).alias("section_count"),
        F.count_if(hl).alias("_hl"),
        F.count_if(ct).alias("_ct"),
        F.max(contains_any(c, keywords)).alias("cites_news"),
    )
    has_hl = F.col("_hl") >= min_highlights
    return g.select(
        *key, "word_count", "section_count", has_hl.alias("has_highlights"),
        (F.col("_ct") > 0).alias("has_contradictions"), "cites_news",
        (F.col("word_count").between(min_words, max_words) & (F.col("section_count") >= min_sections) & has_hl).alias("pass"),
    )


def judge_score(raw: Column, field: str = "score", context: Column | None = None,
                default: float = JUDGE_DEFAULT) -> Column:
    """A judge's JSON answer -> score.  Lax: "0.8" counts as 0.8.  Missing field,
    bad JSON or a failed call -> ``default``.  With ``context``: an empty
    context or the no-hits sentence scores 0.0 without asking the judge."""
    got = F.try_variant_get(F.try_parse_json(raw), f"$.{field}", "double")
    score = F.coalesce(got, F.lit(default))
    if context is None:
        return score
    empty = F.coalesce(context, F.lit("")) == ""
    none = F.coalesce(context.startswith(NO_HITS_TEXT[:3]), F.lit(False))
    return F.when(empty | none, F.lit(0.0)).otherwise(score)


def overall_score(retrieval: Column, consistency: Column, passed: Column) -> Column:
    """round(0.25 r + 0.25 c + 0.5 (1.0 if pass else 0.5), 2), half-up."""
    q = F.when(passed, F.lit(1.0)).otherwise(F.lit(QUALITY_FAIL_CREDIT))
    raw = F.lit(WEIGHT_RETRIEVAL) * retrieval + F.lit(WEIGHT_CONSISTENCY) * consistency + F.lit(WEIGHT_QUALITY) * q
    return round_half_up(raw, 2)


def eval_card(date: Column, retrieval: Column, consistency: Column, quality: Column) -> Column:
    """The daily card: date, both scores, the quality struct and the weighted score."""
    return F.struct(date.alias("date"), retrieval.alias("retrieval_precision"), consistency.alias("cross_agent_consistency"),
                    quality.alias("report_quality"), overall_score(retrieval, consistency, quality["pass"]).alias("overall_score"))
