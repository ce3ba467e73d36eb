"""Gathering per-date analyst results and routing questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas

# Neutral fillers used when an analyst failed (confidence 0.1).
DEFAULT_RESULTS_SQL = {
    "macro": (
        "named_struct('pe_valuation', named_struct('current_pe', 30D, 'historical_max', 60D, "
        "'historical_min', 10D, 'historical_mean', 35D, 'percentile', 50D, 'assessment', 'fair'), "
        "'market_breadth', named_struct('up_count', 0L, 'down_count', 0L, 'flat_count', 0L, "
        "'avg_change_pct', 0D, 'breadth_signal', 'neutral'), "
        "'economic_events', CAST(array() AS array<string>), 'sentiment', '未知（分析失败）', "
        "'key_drivers', CAST(array() AS array<string>), 'confidence', 0.1D)"
    ),
    "technical": (
        "named_struct('trend', '未知', 'trend_strength', '弱', 'support_level', CAST(NULL AS double), "
        "'resistance_level', CAST(NULL AS double), 'index_summary', '分析失败', "
        "'momentum_signals', CAST(array() AS array<string>), 'confidence', 0.1D)"
    ),
    "fund_flow": (
        "named_struct('top_turnover_stocks', CAST(array() AS array<struct<code: string, name: string, "
        "amount: double, change_pct: double>>), 'sector_rotation', CAST(array() AS array<struct<"
        "sector_name: string, avg_change_pct: double, total_amount: double, direction: string>>), "
        "'capital_direction', '未知', 'concentration_note', '分析失败', 'confidence', 0.1D)"
    ),
    "risk": (
        "named_struct('concentration_risk', '未知', 'volatility_assessment', '未知', "
        "'external_risks', CAST(array() AS array<string>), 'stock_warnings', CAST(array() AS array<string>), "
        "'fragility_score', 0.5D, 'overall_risk_level', 'medium', 'confidence', 0.1D)"
    ),
}


def gather(results: DataFrame, key: Sequence[str], kind: str, value: str,
           kinds: Sequence[str] = tuple(schemas.ANALYSTS),
           defaults: dict[str, Column] | None = None, policy: str = "default",
           version: str | None = None) -> DataFrame:
    """One row per ``key`` with one column per kind (a pivot with fixed values).

    policy 'default': a missing kind gets ``defaults[kind]`` (the neutral
    filler).  policy 'fail': rows missing any kind keep nulls and get a
    ``missing`` array naming the absent kinds; pass them to ``gather_errors``.
    Several rows of one kind for one key resolve to the latest by ``version``
    (ties, and no version: the greatest value).
    """
    def pick(k: str) -> Column:
        mine = F.col(kind) == k
        if version is None:
            return F.max(F.when(mine, F.col(value)))
        return F.max(F.when(mine & F.col(value).isNotNull(), F.struct(F.col(version).alias("v"), F.col(value).alias("x"))))["x"]

    aggs = [pick(k).alias(k) for k in kinds]
    g = results.groupBy(*key).agg(*aggs)
    if policy == "default":
        dflt = defaults if defaults is not None else {k: F.expr(DEFAULT_RESULTS_SQL[k]) for k in kinds if k in DEFAULT_RESULTS_SQL}
        return g.select(*key, *[F.coalesce(F.col(k), dflt[k]).alias(k) if k in dflt else F.col(k) for k in kinds])
    if policy == "fail":
        missing = F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in kinds]), lambda x: x.isNotNull())
        return g.withColumn("missing", missing)
    raise ValueError(f"unknown policy {policy!r}")


def gather_errors(gathered: DataFrame, key: Sequence[str]) -> DataFrame:
    """Error rows (key..., analyst, message) for a 'fail' gather."""
    e = gathered.select(*key, F.explode("missing").alias("analyst"))
    return e.withColumn("message", F.concat(F.lit("missing "), F.col("analyst"), F.lit("_result")))


def successful(results: DataFrame, status: str = "status") -> DataFrame:
    """Keep only successful outputs."""
    return results.where(F.col(status) == "ok")


# Routing words in precedence order, the default label and the
# label used when classification itself failed.
ROUTE_RULES = [("stock", "stock"), ("no_data", "no_data")]
ROUTE_DEFAULT = "off_topic"
ROUTE_ON_ERROR = "stock"


def label_route(raw: Column | str, rules: Sequence[tuple[str, str]] = ROUTE_RULES,
                default: str = ROUTE_DEFAULT, on_error: str = ROUTE_ON_ERROR,
                question: Column | str | None = None) -> Column:
    """Normalise a classifier answer into a route label.

    null answer (the call failed) -> ``on_error``; otherwise the first rule
    whose word occurs in lower(trim(answer)); else ``default``.  A blank
    question short-circuits to 'blank'.
    """
    r = F.col(raw) if isinstance(raw, str) else raw
    t = F.lower(F.trim(r))
    expr = F.when(r.isNull(), F.lit(on_error))
    for word, label in rules:
        expr = expr.when(F.contains(t, F.lit(word)), F.lit(label))
    expr = expr.otherwise(F.lit(default))
    if question is not None:
        q = F.col(question) if isinstance(question, str) else question
        expr = F.when(F.coalesce(F.trim(q), F.lit("")) == "", F.lit("blank")).otherwise(expr)
    return expr
