"""News shaping for the knowledge base."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import META_TITLE_CHARS, MIN_ARTICLE_CHARS, blank_to_null, head, md5_id
from .rank import row_number_by
from .topn import top_n


@dataclass(frozen=True)
class SourceMapping:
    """How one vendor feed maps onto the common news schema.

    Each field is a column expression over the vendor frame (or None).
    ``title`` falls back to ``title_fallback`` when blank, then both are cut
    to ``title_chars``.  A missing url is synthesised as
    ``{url_prefix}{crawl_date}_{n}`` with n the 0-based position in ``order``.
    """

    source: str
    title: Column | None = None
    title_fallback: Column | None = None
    content: Column | None = None
    publish_time: Column | None = None
    stock_code: Column | None = None
    url: Column | None = None
    url_prefix: str | None = None
    title_chars: int = 100
    cap: int | None = None
    order: Sequence[str] = ()


def normalise_news(df: DataFrame, m: SourceMapping, crawl_date: Column | str) -> DataFrame:
    """Vendor rows -> common news rows (title, content, publish_time, source,
    stock_code, url, crawl_date), with the per-source cap (P9) applied in
    ``order`` (per crawl date)."""
    day = F.lit(crawl_date) if isinstance(crawl_date, str) else crawl_date
    base = df.withColumn("_day", day.cast("string"))
    if m.cap is not None or m.url_prefix is not None:
        order_cols = list(m.order)
        if not order_cols:
            raise ValueError("a cap or a synthesised url needs an explicit row order")
        if m.cap is not None:
            # first `cap` rows per day, numbered (partial WindowGroupLimit: at
            # most `cap` rows per day leave each task)
            base = top_n(base.withColumn("_o", F.struct(*order_cols)), "_o", m.cap,
                         desc=False, tiebreak=(), by=["_day"], rank_col="_n")
        else:
            # number every row of a day without putting the day in one task
            base = row_number_by(base, [F.col(c).asc() for c in order_cols], by=["_day"], out="_n")
    def nz(c: Column | None) -> Column:
        return c.cast("string") if c is not None else F.lit(None).cast("string")
    title = blank_to_null(nz(m.title))
    if m.title_fallback is not None:
        title = F.coalesce(title, nz(m.title_fallback))
    url = nz(m.url)
    if m.url_prefix is not None:
        url = F.coalesce(url, F.concat(F.lit(m.url_prefix), F.col("_day"), F.lit("_"), (F.col("_n") - 1).cast("string")))
    return base.select(
        head(title, m.title_chars).alias("title"),
        nz(m.content).alias("content"),
        nz(m.publish_time).alias("publish_time"),
        F.lit(m.source).alias("source"),
        nz(m.stock_code).alias("stock_code"),
        url.alias("url"),
        F.col("_day").alias("crawl_date"),
    )


def union_sources(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    """UNION ALL of the feeds that produced a frame; a failed feed adds nothing."""
    present = [f for f in frames if f is not None]
    if not present:
        return None
    out = present[0]
    for f in present[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Drop articles with a missing or empty url."""
    return df.where(F.coalesce(F.col(url), F.lit("")) != "")


def article_text(title: str = "title", content: str = "content") -> Column:
    """title + newline + content, a missing part counting as empty."""
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(content), F.lit("")))


def dedupe_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in ``order``.

    min(struct(order..., row...)) per key: deterministic (unlike
    dropDuplicates) and a partial aggregate, so a key repeated in a third of
    all rows is combined map-side instead of landing on one reducer.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(F.min(packed).alias("_first"))
    return out.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in list(order) + rest])


def metadata(title: str = "title", source: str = "source", date: str = "date",
             url: str = "url", batch_date: Column | str | None = None) -> Column:
    """Knowledge-base metadata struct (P7): title cut to 200, source default
    'unknown', date default = the batch date."""
    dflt = F.lit(batch_date) if isinstance(batch_date, str) else batch_date
    d = F.col(date) if date else F.lit(None).cast("string")
    return F.struct(
        head(F.coalesce(F.col(title), F.lit("")), META_TITLE_CHARS).alias("title"),
        F.coalesce(F.col(source), F.lit("unknown")).alias("source"),
        (F.coalesce(d, dflt) if dflt is not None else d).cast("string").alias("date"),
        F.col(url).alias("url"),
    )


def first_articles(news: DataFrame, batch_date: Column | str, order: Sequence[str], key_col: str = "url") -> DataFrame:
    """The day's first article per md5(url), however short: id, document,
    metadata, batch_date and the ``order`` columns.  Empty urls are dropped."""
    has_date = "date" in news.columns
    for c in ("title", "content", "source"):
        if c not in news.columns:
            news = news.withColumn(c, F.lit(None).cast("string"))
    day = F.lit(batch_date) if isinstance(batch_date, str) else batch_date
    n = with_url(news, key_col).withColumn("id", md5_id(key_col)).withColumn("_batch_date", day.cast("string"))
    first = dedupe_first(n, ["id", "_batch_date"], order)
    return first.select(
        "id",
        article_text().alias("document"),
        metadata("title", "source", "date" if has_date else None, key_col, F.col("_batch_date")).alias("metadata"),
        F.col("_batch_date").alias("batch_date"),
        *order,
    )


def long_enough(document: str = "document") -> Column:
    return F.length(document) >= MIN_ARTICLE_CHARS


def prepare_articles(news: DataFrame, batch_date: Column | str, order: Sequence[str],
                     key_col: str = "url") -> DataFrame:
    """News of one or many days -> knowledge-base rows (id, document, metadata,
    batch_date), one per id and day; the upsert lets the later day win.

    Order of steps matters: drop empty urls, keep the day's first article per
    md5(url), only then drop texts shorter than 20 chars.
    """
    first = first_articles(news, batch_date, order, key_col)
    return first.where(long_enough()).select("id", "document", "metadata", "batch_date")


def empty_news(spark) -> DataFrame:
    return spark.createDataFrame([], schemas.NEWS)
