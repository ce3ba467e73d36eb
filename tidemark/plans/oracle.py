"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Only base tables are registered in the oracle, so the shared derived views
are inlined as CTEs.  Rounding goes through DECIMAL on both sides.
"""

from __future__ import annotations

from .. import schemas
from ..functions.text import CONTEXT_EXCERPT_CHARS
from ..operators import render, structured


def r(expr: str, n: int) -> str:
    """Half-up rounding through DECIMAL, as the Spark side does."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,8)), {n}) AS DOUBLE)"


def msum(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


def mean(expr: str) -> str:
    """An order-independent mean: exact sum at 8 places, divided once."""
    return f"CAST(SUM(CAST({expr} AS DECIMAL(30,8))) AS DOUBLE) / COUNT({expr})"


_SPLIT = "TIMESTAMP '1998-07-01 00:00:00'"

QUOTES_CTE = f"""
la AS (
  SELECT l_partkey,
    CAST(SUM(CASE WHEN l_shipdate >= {_SPLIT} THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS ext_new,
    CAST(SUM(CASE WHEN l_shipdate >= {_SPLIT} THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS qty_new,
    CAST(SUM(CASE WHEN l_shipdate < {_SPLIT} THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS ext_old,
    CAST(SUM(CASE WHEN l_shipdate < {_SPLIT} THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS qty_old,
    CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
    CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM lineitem GROUP BY l_partkey),
lp AS (
  SELECT p.p_partkey AS code, p.p_name AS name, p.p_brand AS sector,
    CASE WHEN la.qty_new <> 0 THEN la.ext_new / la.qty_new END AS price,
    CASE WHEN la.qty_old <> 0 THEN la.ext_old / la.qty_old END AS prev,
    la.volume, la.amount
  FROM part p JOIN la ON p.p_partkey = la.l_partkey),
raw_quotes AS (
  SELECT code, name, sector, price,
    CASE WHEN prev > 0 THEN {r("(price - prev) / prev * 100", 0)} END AS change_pct,
    volume, amount
  FROM lp),
quotes AS (
  SELECT sector, code, name, price, change_pct, volume AS volume_num, amount AS amount_num
  FROM raw_quotes WHERE code IS NOT NULL AND price IS NOT NULL AND price > 0)
"""

BARS_CTE = """
bars AS (
  SELECT CAST(ts AS DATE) AS d, min_by(value, (ts, event_id)) AS open, max_by(value, (ts, event_id)) AS close,
    MAX(value) AS high, MIN(value) AS low
  FROM events GROUP BY 1)
"""

YEARLY_CTE = f"""
yearly AS (
  SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS yr,
    {r(mean("o_totalprice"), 2)} AS v
  FROM orders GROUP BY 1)
"""


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


ORACLE: dict[str, str] = {}

ORACLE["market_summary"] = with_([QUOTES_CTE], f"""
SELECT COUNT(*) FILTER (WHERE change_pct > 0) AS up_count,
       COUNT(*) FILTER (WHERE change_pct < 0) AS down_count,
       COUNT(*) FILTER (WHERE change_pct = 0) AS flat_count,
       COUNT(*) AS total_count,
       {r("CAST(SUM(CAST(change_pct AS DECIMAL(30,8))) AS DOUBLE) / COUNT(change_pct)", 4)} AS avg_change_pct,
       {r("STDDEV_SAMP(change_pct)", 4)} AS std_change_pct,
       {r(msum("amount_num"), 0)} AS total_amount
FROM quotes""")

ORACLE["clean_quotes"] = with_([QUOTES_CTE], """
SELECT code, name, price, change_pct, volume_num, amount_num FROM quotes""")

ORACLE["top_gainers"] = with_([QUOTES_CTE], """
SELECT code, name, change_pct FROM quotes WHERE change_pct IS NOT NULL
ORDER BY change_pct DESC, code ASC LIMIT 20""")

ORACLE["top_losers"] = with_([QUOTES_CTE], """
SELECT code, name, change_pct FROM quotes WHERE change_pct IS NOT NULL
ORDER BY change_pct ASC, code ASC LIMIT 20""")

ORACLE["top_amount"] = with_([QUOTES_CTE], f"""
SELECT code, name, {r("amount_num", 0)} AS amount, change_pct FROM quotes WHERE amount_num IS NOT NULL
ORDER BY amount_num DESC, code ASC LIMIT 20""")

ORACLE["sector_stats"] = with_([QUOTES_CTE], f"""
SELECT sector, COUNT(*) AS stock_count,
       {r("CAST(SUM(CAST(change_pct AS DECIMAL(30,8))) AS DOUBLE) / COUNT(change_pct)", 2)} AS avg_change,
       {r(msum("amount_num"), 0)} AS total_amount
FROM quotes WHERE sector IS NOT NULL GROUP BY sector""")

ORACLE["sector_top3"] = with_([QUOTES_CTE], """
SELECT sector, code, amount_num AS amount FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sector ORDER BY amount_num DESC, code) AS rn
  FROM quotes WHERE amount_num IS NOT NULL) x
WHERE rn <= 3""")

ORACLE["big_losers"] = with_([QUOTES_CTE], """
SELECT COUNT(*) AS n FROM (
  SELECT change_pct FROM quotes WHERE change_pct IS NOT NULL ORDER BY change_pct ASC, code LIMIT 20) x
WHERE ABS(change_pct) > 5""")

ORACLE["concentration"] = with_([QUOTES_CTE, f"""
t AS (SELECT {msum("amount_num")} AS total FROM quotes)""", """
s AS (SELECT
    CAST(SUM(CAST(amount_num AS DECIMAL(18,2))) FILTER (WHERE rn <= 10) AS DOUBLE) AS s10,
    CAST(SUM(CAST(amount_num AS DECIMAL(18,2))) FILTER (WHERE rn <= 50) AS DOUBLE) AS s50
  FROM (SELECT amount_num, ROW_NUMBER() OVER (ORDER BY amount_num DESC) AS rn
        FROM quotes WHERE amount_num IS NOT NULL) z)"""], f"""
SELECT CASE WHEN total > 0 THEN {r("s10 / total * 100", 2)} ELSE 0.0 END AS top10_pct,
       CASE WHEN total > 0 THEN {r("s50 / total * 100", 2)} ELSE 0.0 END AS top50_pct
FROM s, t""")

ORACLE["amount_rank"] = with_([QUOTES_CTE], f"""
SELECT code, CAST(ROW_NUMBER() OVER (ORDER BY amount_num DESC NULLS LAST, code) AS BIGINT) AS rn,
       (SELECT {r(msum("amount_num"), 0)} FROM quotes) AS total_market_amount
FROM quotes""")

ORACLE["index_range_stats"] = with_([BARS_CTE], f"""
SELECT {r("MIN(close)", 2)} AS close_min, {r("MAX(close)", 2)} AS close_max,
       {r(mean("close"), 2)} AS close_avg,
       {r("STDDEV_SAMP(CASE WHEN open <> 0 THEN (close - open) / open * 100 END)", 2)} AS volatility
FROM bars""")

ORACLE["bar_return"] = with_([BARS_CTE], """
SELECT d, (close - open) / open * 100 AS change_pct FROM bars WHERE open <> 0""")

ORACLE["pe_by_year"] = f"""
SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS year,
       {r(mean("o_totalprice"), 2)} AS avg_pe_val
FROM orders GROUP BY 1"""

ORACLE["pe_percentile"] = with_([YEARLY_CTE, "c AS (SELECT max_by(v, yr) AS cur FROM yearly)"], f"""
SELECT MAX(c.cur) AS current, MAX(v) AS max, MIN(v) AS min,
       {r(mean("v"), 4)} AS mean,
       {r("CAST(COUNT(*) FILTER (WHERE v < c.cur) AS DOUBLE) / COUNT(*) * 100", 1)} AS percentile
FROM yearly, c""")

ORACLE["news_dedup"] = """
WITH d AS (SELECT md5(text) AS id, doc_id, text,
             ROW_NUMBER() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn
           FROM documents WHERE COALESCE(text, '') <> '')
SELECT id, doc_id, CAST(LENGTH(text) AS BIGINT) AS n FROM d WHERE rn = 1 AND LENGTH(text) >= 20"""

ORACLE["kb_upsert"] = """
WITH u AS (SELECT md5(text) AS id, doc_id, source, doc_id % 7 AS batch FROM documents),
 r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, batch ORDER BY doc_id) AS k FROM u),
 f AS (SELECT * FROM r WHERE k = 1),
 l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY batch DESC) AS z FROM f)
SELECT id, doc_id, source, batch FROM l WHERE z = 1"""

ORACLE["news_union"] = """
SELECT 'doc/' || CAST(doc_id AS VARCHAR) AS url,
       substr(CASE WHEN trim(text) = '' THEN NULL ELSE text END, 1, 100) AS title, 'documents' AS source
FROM documents
UNION ALL
SELECT url, substr(COALESCE(CASE WHEN trim(regexp_extract(html, '<title>(.*?)</title>', 1)) = '' THEN NULL
                               ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END, html), 1, 100) AS title,
       'pages' AS source
FROM pages
UNION ALL
SELECT 'conv/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS url,
       substr(CASE WHEN trim(text) = '' THEN NULL ELSE text END, 1, 100) AS title, 'conversations' AS source
FROM conversations"""

ORACLE["news_metadata"] = """
WITH p AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, html AS content,
                  CAST(NULL AS VARCHAR) AS source, url, md5(url) AS id
           FROM pages WHERE COALESCE(url, '') <> ''),
 f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY page_id) AS rn FROM p),
 t AS (SELECT *, COALESCE(title, '') || chr(10) || COALESCE(content, '') AS document FROM f WHERE rn = 1)
SELECT id, substr(COALESCE(title, ''), 1, 200) AS title, COALESCE(source, 'unknown') AS source,
       '20240101' AS date, url, CAST(LENGTH(document) AS BIGINT) AS n
FROM t WHERE LENGTH(document) >= 20"""

ORACLE["semi_topk"] = """
WITH t AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY o_custkey),
 k AS (SELECT o_custkey FROM t WHERE total IS NOT NULL ORDER BY total DESC, o_custkey LIMIT 20)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT o_custkey FROM k)"""

ORACLE["new_only_anti"] = """
SELECT doc_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)"""

ORACLE["sector_left_join"] = f"""
SELECT d.lang, COUNT(*) AS n,
       {r("CAST(SUM(CAST(l.quality AS DECIMAL(30,8))) AS DOUBLE) / COUNT(l.quality)", 4)} AS avg_quality
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL GROUP BY d.lang"""

_VEC_CTE = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
x AS (SELECT label, unnest(v) AS val, generate_subscripts(v, 1) AS pos FROM e)"""

ORACLE["vector_topk"] = with_([_VEC_CTE, """
c AS (SELECT pos, AVG(val) AS m FROM x GROUP BY pos),
q AS (SELECT list(m ORDER BY pos) AS q FROM c),
s AS (SELECT e.vec_id, 1 - list_cosine_similarity(e.v, q.q) AS dist FROM e, q),
t AS (SELECT *, ROW_NUMBER() OVER (ORDER BY dist, vec_id) AS rk FROM s WHERE dist IS NOT NULL AND NOT isnan(dist))"""],
f"""
SELECT CAST(rk AS INTEGER) AS rank, vec_id, {r("GREATEST(0.0, 1 - dist)", 6)} AS similarity FROM t WHERE rk <= 10""")

ORACLE["vector_topk_many"] = with_([_VEC_CTE, """
c AS (SELECT label, pos, AVG(val) AS m FROM x GROUP BY label, pos),
q AS (SELECT label, list(m ORDER BY pos) AS q FROM c GROUP BY label),
s AS (SELECT q.label, e.vec_id, 1 - list_cosine_similarity(e.v, q.q) AS dist FROM e, q),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY dist, vec_id) AS rk
      FROM s WHERE dist IS NOT NULL AND NOT isnan(dist))"""],
f"""
SELECT label, CAST(rk AS INTEGER) AS rank, vec_id, {r("GREATEST(0.0, 1 - dist)", 6)} AS similarity
FROM t WHERE rk <= 10""")

ORACLE["vector_topk_rows"] = f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, e.vec_id, 1 - list_cosine_similarity(e.v, q.v) AS dist FROM e, e AS q WHERE q.vec_id % 20 = 0),
t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk
      FROM s WHERE dist IS NOT NULL AND NOT isnan(dist))
SELECT qid, CAST(rk AS INTEGER) AS rank, vec_id, {r("GREATEST(0.0, 1 - dist)", 6)} AS similarity
FROM t WHERE rk <= 10"""

_FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
_FENCE_ANY = r"(?s)```(?:json)?\s*\n?.*?\n?```"
_STRIP = r"^\s+|\s+$"

ORACLE["fence_extract"] = f"""
WITH w AS (SELECT doc_id, 'pre ```json' || chr(10) || text || chr(10) || '``` post' AS w FROM documents)
SELECT doc_id,
  CASE WHEN regexp_matches(w, '{_FENCE_ANY}')
       THEN regexp_replace(regexp_extract(w, '{_FENCE}', 1), '{_STRIP}', '', 'g') END AS body
FROM w"""

ORACLE["structured_parse"] = """
WITH c AS (SELECT conv_id, turn, role, CAST(LENGTH(text) AS DOUBLE) / 1000.0 AS conf FROM conversations)
SELECT conv_id, turn,
  CASE WHEN role = 'user' THEN 'not_json'
       WHEN role = 'assistant' THEN CASE WHEN conf BETWEEN 0 AND 1 THEN 'ok' ELSE 'range' END
       ELSE 'missing' END AS status,
  CASE WHEN role = 'assistant' AND conf BETWEEN 0 AND 1 THEN conf END AS confidence
FROM c"""

ORACLE["gather_defaults"] = """
SELECT conv_id,
  MAX(CASE WHEN role = 'user' THEN CAST(LENGTH(text) AS BIGINT) END) AS "user",
  MAX(CASE WHEN role = 'assistant' THEN CAST(LENGTH(text) AS BIGINT) END) AS assistant,
  COALESCE(MAX(CASE WHEN role = 'system' THEN CAST(LENGTH(text) AS BIGINT) END), CAST(-1 AS BIGINT)) AS system
FROM conversations GROUP BY conv_id"""

ORACLE["label_route"] = """
SELECT conv_id, turn,
  CASE WHEN text IS NULL THEN 'stock'
       WHEN contains(lower(trim(text)), 'the') THEN 'stock'
       WHEN contains(lower(trim(text)), 'ou') THEN 'no_data'
       ELSE 'off_topic' END AS label
FROM conversations"""

ORACLE["report_quality"] = """
WITH a AS (
  SELECT conv_id, CAST(SUM(LENGTH(COALESCE(text, '')) + 1) AS BIGINT) AS word_count,
         COUNT(*) AS section_count,
         COUNT(*) FILTER (WHERE role = 'user') AS hl,
         COUNT(*) FILTER (WHERE role = 'system') AS ct,
         string_agg(COALESCE(text, '') || chr(10), '' ORDER BY turn) AS body
  FROM conversations GROUP BY conv_id)
SELECT conv_id, word_count, section_count, hl >= 2 AS has_highlights, ct > 0 AS has_contradictions,
  (contains(body, '新闻') OR contains(body, '报道') OR contains(body, '消息') OR contains(body, 'RAG')) AS cites_news,
  (word_count BETWEEN 100 AND 2000 AND section_count >= 4 AND hl >= 2) AS pass
FROM a"""

ORACLE["render_report"] = """
WITH sec AS (
  SELECT conv_id,
    string_agg('## ' || role || chr(10) || chr(10) || text || chr(10) || chr(10) || '*(' || role || ' 提供)*' || chr(10),
               chr(10) ORDER BY turn) AS md,
    arg_min(text, turn) AS summary
  FROM conversations GROUP BY conv_id),
 hl AS (SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn) AS md
        FROM conversations WHERE role = 'user' GROUP BY conv_id),
 ct AS (SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn) AS md
        FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT sec.conv_id, concat_ws(chr(10),
    '# A股市场日报 (' || CAST(sec.conv_id AS VARCHAR) || ')', '',
    '> **综合判断**: 中性 | **风险等级**: medium', '',
    '## 摘要', '', sec.summary, '',
    sec.md,
    '## 关键要点', '',
    hl.md, '',
    CASE WHEN ct.md IS NOT NULL THEN concat_ws(chr(10), '## 分析师分歧说明', '', ct.md, '') END,
    '---', '*报告由多智能体系统自动生成*') AS markdown
FROM sec LEFT JOIN hl ON sec.conv_id = hl.conv_id LEFT JOIN ct ON sec.conv_id = ct.conv_id"""


def pct0(expr: str) -> str:
    return f"(printf('%.0f', CAST(ROUND(CAST({expr} AS DECIMAL(38,8)) * 100, 0) AS DOUBLE)) || '%')"


ORACLE["render_context"] = f"""
WITH h AS (
  SELECT conv_id, turn,
    '---' || chr(10) || '【' || CAST(turn + 1 AS VARCHAR) || '】' || COALESCE(role, '无标题') || chr(10)
    || '来源: conversations | 日期: ? | 相关度: ' || {pct0("CAST(1.0 AS DOUBLE) / (turn + 1)")} || chr(10)
    || substr(COALESCE(text, ''), 1, 300) AS line
  FROM conversations)
SELECT conv_id,
  '以下是通过 RAG 检索到的 ' || CAST(COUNT(*) AS VARCHAR) || ' 条相关财经新闻：' || chr(10) || chr(10)
  || string_agg(line, chr(10) ORDER BY turn) AS context
FROM h GROUP BY conv_id"""

_K = "COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), CAST(0.5 AS DOUBLE))"
ORACLE["judge_score"] = f"""
SELECT event_id, {_K} AS k_score,
  COALESCE(TRY_CAST(json_extract_string(props, '$.score') AS DOUBLE), CAST(0.5 AS DOUBLE)) AS absent_score,
  CASE WHEN event_type = 'error' THEN CAST(0.0 AS DOUBLE) ELSE {_K} END AS retrieval
FROM events"""

ORACLE["eval_overall"] = f"""
SELECT doc_id, {r("CAST(0.25 AS DOUBLE) * quality + CAST(0.25 AS DOUBLE) * (1 - toxic) + CAST(0.5 AS DOUBLE) * (CASE WHEN toxic = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END)", 2)} AS overall
FROM labels"""

ORACLE["render_answer"] = f"""
SELECT doc_id,
  CASE WHEN quality = 0 AND toxic = 1 THEN '| ⚠️ 风险分析师 | ❌ 分析失败 | - |'
       ELSE '| ⚠️ 风险分析师 | 风险' || CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END || '，脆弱度'
            || {pct0("CAST(0.15 AS DOUBLE) + CAST(0.7 AS DOUBLE) * toxic")} || ' | '
            || {pct0("CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) * quality")} || ' |' END AS line
FROM labels"""

ORACLE["sector_map_flatten"] = """
SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_brand AS industry FROM part"""

ORACLE["concentration_by"] = f"""
WITH l AS (SELECT p.p_brand AS sector, li.l_extendedprice AS amount
           FROM lineitem li JOIN part p ON li.l_partkey = p.p_partkey),
 rk AS (SELECT sector, amount, ROW_NUMBER() OVER (PARTITION BY sector ORDER BY amount DESC) AS rn
        FROM l WHERE amount IS NOT NULL),
 t AS (SELECT sector, {msum("amount")} AS total FROM l GROUP BY sector),
 s AS (SELECT sector,
         CAST(SUM(CASE WHEN rn <= 10 THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE) AS s10,
         CAST(SUM(CASE WHEN rn <= 50 THEN CAST(amount AS DECIMAL(18,2)) END) AS DOUBLE) AS s50
       FROM rk WHERE rn <= 50 GROUP BY sector)
SELECT t.sector,
  CASE WHEN total > 0 THEN {r("COALESCE(s10, 0.0) / total * 100", 2)} ELSE 0.0 END AS top10_pct,
  CASE WHEN total > 0 THEN {r("COALESCE(s50, 0.0) / total * 100", 2)} ELSE 0.0 END AS top50_pct
FROM t LEFT JOIN s ON t.sector = s.sector"""


def fx(expr: str, d: int) -> str:
    return f"printf('%.{d}f', {r(expr, d)})"


ORACLE["focus_text"] = with_([QUOTES_CTE, BARS_CTE, YEARLY_CTE, f"""
spot AS (SELECT COUNT(*) FILTER (WHERE change_pct > 0) AS up_count,
       COUNT(*) FILTER (WHERE change_pct < 0) AS down_count,
       COUNT(*) FILTER (WHERE change_pct = 0) AS flat_count,
       {r("CAST(SUM(CAST(change_pct AS DECIMAL(30,8))) AS DOUBLE) / COUNT(change_pct)", 4)} AS avg_change_pct,
       {r("STDDEV_SAMP(change_pct)", 4)} AS std_change_pct
  FROM quotes)""", "c AS (SELECT max_by(v, yr) AS cur FROM yearly)", f"""
pe AS (SELECT MAX(c.cur) AS current, MAX(v) AS max, MIN(v) AS min,
       {r(mean("v"), 4)} AS mean,
       {r("CAST(COUNT(*) FILTER (WHERE v < c.cur) AS DOUBLE) / COUNT(*) * 100", 1)} AS percentile
  FROM yearly, c)""", f"""
tot AS (SELECT {msum("amount_num")} AS total FROM quotes)""", """
srk AS (SELECT
    CAST(SUM(CAST(amount_num AS DECIMAL(18,2))) FILTER (WHERE rn <= 10) AS DOUBLE) AS s10,
    CAST(SUM(CAST(amount_num AS DECIMAL(18,2))) FILTER (WHERE rn <= 50) AS DOUBLE) AS s50
  FROM (SELECT amount_num, ROW_NUMBER() OVER (ORDER BY amount_num DESC) AS rn
        FROM quotes WHERE amount_num IS NOT NULL) z)""", f"""
conc AS (SELECT CASE WHEN total > 0 THEN {r("s10 / total * 100", 2)} ELSE 0.0 END AS top10_pct,
       CASE WHEN total > 0 THEN {r("s50 / total * 100", 2)} ELSE 0.0 END AS top50_pct FROM srk, tot)""", f"""
idx AS (SELECT {r("MIN(close)", 2)} AS close_min, {r("MAX(close)", 2)} AS close_max,
       max_by(close, d) AS close,
       {r(mean("CASE WHEN open <> 0 THEN (close - open) / open * 100 END"), 2)} AS avg_change_pct
  FROM bars)""", f"""
ta AS (SELECT code, name, {r("amount_num", 0)} AS amount, change_pct, amount_num FROM quotes
  WHERE amount_num IS NOT NULL ORDER BY amount_num DESC, code LIMIT 10)""", f"""
ss AS (SELECT * FROM (SELECT sector,
         {r("CAST(SUM(CAST(change_pct AS DECIMAL(30,8))) AS DOUBLE) / COUNT(change_pct)", 2)} AS avg_change,
         {r(msum("amount_num"), 0)} AS total_amount
       FROM quotes WHERE sector IS NOT NULL GROUP BY sector) x ORDER BY avg_change DESC, sector LIMIT 8)""", """
tl AS (SELECT code, name, change_pct FROM quotes WHERE change_pct IS NOT NULL ORDER BY change_pct, code LIMIT 20)""", """
bl AS (SELECT *, ROW_NUMBER() OVER (ORDER BY change_pct, code) AS k FROM tl WHERE ABS(change_pct) > 5)"""],
f"""
SELECT 'macro' AS analyst,
  chr(10) || 'PE 估值数据：' || chr(10) || '  当前 PE: ' || CAST(pe.current AS VARCHAR) || chr(10)
  || '  历史最高: ' || CAST(pe.max AS VARCHAR) || chr(10) || '  历史最低: ' || CAST(pe.min AS VARCHAR) || chr(10)
  || '  历史均值: ' || CAST(pe.mean AS VARCHAR) || chr(10) || '  当前分位数: ' || CAST(pe.percentile AS VARCHAR) || '%'
  || chr(10) || chr(10) || '市场广度数据：' || chr(10) || '  上涨: ' || CAST(spot.up_count AS VARCHAR) || ' 只' || chr(10)
  || '  下跌: ' || CAST(spot.down_count AS VARCHAR) || ' 只' || chr(10) || '  平盘: ' || CAST(spot.flat_count AS VARCHAR)
  || ' 只' || chr(10) || '  平均涨跌幅: ' || CAST(spot.avg_change_pct AS VARCHAR) || '%' || chr(10) AS focus
FROM pe, spot
UNION ALL
SELECT 'technical',
  chr(10) || '沪深300 指数数据：' || chr(10) || '  收盘价: ' || CAST(idx.close AS VARCHAR) || chr(10)
  || '  区间最低: ' || CAST(idx.close_min AS VARCHAR) || chr(10) || '  区间最高: ' || CAST(idx.close_max AS VARCHAR)
  || chr(10) || '  区间平均涨跌幅: ' || CAST(idx.avg_change_pct AS VARCHAR) || '%' || chr(10) || chr(10)
  || '市场整体涨跌幅分布标准差: ' || CAST(spot.std_change_pct AS VARCHAR) || chr(10)
FROM idx, spot
UNION ALL
SELECT 'fund_flow',
  chr(10) || '成交额 TOP 10 个股：' || chr(10)
  || (SELECT string_agg('  ' || CAST(code AS VARCHAR) || ' ' || name || ' 成交额' || {fx("amount", 0)} || '元 涨跌幅'
                        || {fx("change_pct", 2)} || '%', chr(10) ORDER BY amount_num DESC, code) FROM ta)
  || chr(10) || chr(10) || '板块资金流向：' || chr(10)
  || (SELECT string_agg('  ' || sector || ' 平均涨跌幅' || {fx("avg_change", 2)} || '% 总成交额' || {fx("total_amount", 0)}
                        || '元', chr(10) ORDER BY avg_change DESC, sector) FROM ss)
  || chr(10) || chr(10) || '成交集中度：' || chr(10) || '  Top10 成交额占比: ' || CAST(conc.top10_pct AS VARCHAR) || '%'
  || chr(10) || '  Top50 成交额占比: ' || CAST(conc.top50_pct AS VARCHAR) || '%' || chr(10)
FROM conc
UNION ALL
SELECT 'risk',
  chr(10) || '风险相关数据：' || chr(10) || '  全市场涨跌幅标准差: ' || CAST(spot.std_change_pct AS VARCHAR) || chr(10)
  || '  成交集中度 Top10: ' || CAST(conc.top10_pct AS VARCHAR) || '%' || chr(10)
  || '  成交集中度 Top50: ' || CAST(conc.top50_pct AS VARCHAR) || '%' || chr(10) || chr(10)
  || '跌幅超 5% 个股数: ' || CAST((SELECT COUNT(*) FROM bl) AS VARCHAR) || ' 只' || chr(10) || '跌幅前 5:' || chr(10)
  || COALESCE((SELECT string_agg('  ' || CAST(code AS VARCHAR) || ' ' || name || ' 跌幅 ' || {fx("change_pct", 2)} || '%',
                                 chr(10) ORDER BY k) FROM bl WHERE k <= 5), '  (无)') || chr(10)
FROM spot, conc""")


ORACLE["embed_hash"] = """
WITH p AS (SELECT doc_id, list_transform(string_split(lower(trim(coalesce(text, ''))), ''), lambda c: unicode(c)::BIGINT) AS l FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(l)), lambda i: (l[i] % 256 * 65599 + l[i + 1]) % 256)) AS b FROM p),
n AS (SELECT doc_id, b, COUNT(*) AS c FROM g GROUP BY doc_id, b),
h AS (SELECT doc_id, map(list(b), list(c)) AS m, sqrt(CAST(SUM(c * c) AS DOUBLE)) AS norm FROM n GROUP BY doc_id)
SELECT d.doc_id, list_transform(range(256), lambda b: CAST(COALESCE(h.m[b] / h.norm, 0.0) AS FLOAT)) AS embedding
FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id"""


ORACLE["search_query"] = with_([QUOTES_CTE, f"""
spot AS (SELECT COUNT(*) FILTER (WHERE change_pct > 0) AS up, COUNT(*) FILTER (WHERE change_pct < 0) AS down,
       {r(mean("change_pct"), 4)} AS avg FROM quotes)""", """
g AS (SELECT name, change_pct, code FROM quotes WHERE change_pct IS NOT NULL ORDER BY change_pct DESC, code LIMIT 5)""", """
a AS (SELECT name, amount_num, code FROM quotes WHERE amount_num IS NOT NULL ORDER BY amount_num DESC, code LIMIT 5)"""], """
SELECT '今日A股市场概况：' || chr(10) || '上涨 ' || up || ' 家，下跌 ' || down || ' 家' || chr(10) || '平均涨跌幅 ' || CAST(avg AS VARCHAR) || '%'
       || chr(10) || chr(10) || '涨幅前列: ' || (SELECT string_agg(name, '、' ORDER BY change_pct DESC, code) FROM g)
       || chr(10) || '成交额前列: ' || (SELECT string_agg(name, '、' ORDER BY amount_num DESC, code) FROM a) AS query
FROM spot""")

ORACLE["sector_vendor_codes"] = """
SELECT p_brand AS industry_name, COUNT(*) AS stock_count, COUNT(*) FILTER (WHERE l_partkey IS NULL) AS unmatched
FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem) ON l_partkey = p_partkey
GROUP BY p_brand"""

ORACLE["eval_cards"] = f"""
WITH c AS (SELECT doc_id, CAST(quality AS DOUBLE) AS q, CAST(1 - toxic AS DOUBLE) AS t, toxic = 0 AS ok FROM labels),
s AS (SELECT *, {r("0.25 * q + 0.25 * t + 0.5 * CASE WHEN ok THEN 1.0 ELSE 0.5 END", 2)} AS o FROM c)
SELECT doc_id, o AS overall_score, chr(10) || '## 质量评估' || chr(10) || chr(10) || '| 指标 | 得分 |' || chr(10) || '|------|------|' || chr(10)
       || '| 检索精度 | ' || printf('%.0f', q * 100) || '% |' || chr(10) || '| Agent 一致性 | ' || printf('%.0f', t * 100) || '% |' || chr(10)
       || '| 报告质量 | ' || CASE WHEN ok THEN '通过' ELSE '未通过' END || ' |' || chr(10)
       || '| **综合评分** | **' || printf('%.0f', round(CAST(o * 100 AS DECIMAL(18,4)), 0)) || '%** |' || chr(10) AS score_table
FROM s"""

ORACLE["daily_landing"] = """
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date, COUNT(*) AS n, CAST(SUM(o_orderkey) AS BIGINT) AS keys
FROM orders GROUP BY 1"""

ORACLE["kb_table_upsert"] = """
SELECT id, doc_id, source, batch FROM (
  SELECT md5(text) AS id, doc_id, source, doc_id % 7 AS batch,
         row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id % 7 DESC, doc_id) AS k FROM documents)
WHERE k = 1"""


ORACLE["structured_parse_risk"] = """
WITH r AS (
  SELECT conv_id, turn, CASE WHEN length(text) % 11 = 0 THEN text ELSE
    regexp_replace(CAST(json_object('concentration_risk', text, 'volatility_assessment', role) AS VARCHAR), '\\}$', '')
    || ', "external_risks": ["x"], "stock_warnings": ' || CASE length(text) % 5 WHEN 0 THEN '[1, 2]' WHEN 1 THEN '[null]' ELSE '["a", "b"]' END
    || ', "fragility_score": "' || CAST(length(text) / 400.0 AS VARCHAR) || '", "confidence": 0.5'
    || CASE WHEN length(text) % 7 = 0 THEN '' ELSE ', "overall_risk_level": "low"' END || '}' END AS raw
  FROM conversations),
j AS (SELECT conv_id, turn, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS o FROM r),
f AS (SELECT *, TRY_CAST(o ->> '$.fragility_score' AS DOUBLE) AS fragile, TRY_CAST(o ->> '$.confidence' AS DOUBLE) AS sure FROM j),
s AS (SELECT *, CASE
    WHEN o IS NULL OR json_type(o) <> 'OBJECT' THEN 'not_json'
    WHEN len(list_filter(['concentration_risk', 'volatility_assessment', 'external_risks', 'stock_warnings', 'fragility_score', 'overall_risk_level', 'confidence'],
                         lambda k: coalesce(json_type(o, '$.' || k), 'NULL') = 'NULL')) > 0 THEN 'missing'
    WHEN len(list_filter(['concentration_risk', 'volatility_assessment', 'overall_risk_level'], lambda k: json_type(o, '$.' || k) <> 'VARCHAR')) > 0
      OR len(list_filter(['external_risks', 'stock_warnings'], lambda k: json_type(o, '$.' || k) <> 'ARRAY')) > 0
      OR len(list_filter(json_extract(o, '$.external_risks[*]') || json_extract(o, '$.stock_warnings[*]'), lambda e: json_type(e) <> 'VARCHAR')) > 0
      OR fragile IS NULL OR sure IS NULL THEN 'type'
    WHEN fragile NOT BETWEEN 0 AND 1 OR sure NOT BETWEEN 0 AND 1 THEN 'range'
    ELSE 'ok' END AS status FROM f)
SELECT conv_id, turn, status, CASE WHEN status = 'ok' THEN fragile END AS fragility,
       CASE WHEN status = 'ok' THEN length(o ->> '$.concentration_risk') END AS n_risk
FROM s"""


ORACLE["sector_asof"] = """
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey AS code, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem),
m AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS since, max(o_orderpriority) AS industry FROM orders GROUP BY ALL)
SELECT q.*, m.industry AS industry_name FROM q ASOF LEFT JOIN m ON q.code = m.code AND q.trade_date >= m.since"""

ORACLE["pe_percentile_asof"] = f"""
WITH s AS (SELECT CAST(o_orderdate AS DATE) AS d, {r(mean("o_totalprice"), 2)} AS v FROM orders GROUP BY 1)
SELECT a.d, a.v, count(b.d) AS n_earlier,
       {r("CAST(count(*) FILTER (b.v < a.v) AS DOUBLE) / nullif(count(b.d), 0) * 100", 1)} AS percentile
FROM s a LEFT JOIN s b ON b.d < a.d GROUP BY a.d, a.v"""

ORACLE["price_percentile_asof"] = f"""
SELECT a.o_orderkey, count(b.o_orderkey) AS n_earlier,
       {r("CAST(count(*) FILTER (b.o_totalprice < a.o_totalprice) AS DOUBLE) / nullif(count(b.o_orderkey), 0) * 100", 1)} AS percentile
FROM orders a LEFT JOIN orders b ON b.o_orderpriority = a.o_orderpriority AND b.o_orderdate < a.o_orderdate GROUP BY a.o_orderkey"""


def _trailing(by: str) -> str:
    ret = "CASE WHEN open <> 0 THEN (close - open) / open * 100 END"
    return f"""
SELECT {by}d, count(*) OVER w AS n_bars, {r("min(close) OVER w", 2)} AS close_min, {r("max(close) OVER w", 2)} AS close_max,
       {r("CAST(sum(CAST(close AS DECIMAL(30,8))) OVER w AS DOUBLE) / count(close) OVER w", 2)} AS close_avg,
       {r(f"stddev_samp({ret}) OVER w", 2)} AS volatility
FROM bars WINDOW w AS ({'PARTITION BY o_orderpriority ' if by else ''}ORDER BY d RANGE BETWEEN INTERVAL 364 DAYS PRECEDING AND CURRENT ROW)"""


ORACLE["index_trailing_year"] = with_([BARS_CTE], _trailing(""))

ORACLE["order_trailing_year"] = with_(["""
bars AS (
  SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS d, min_by(o_totalprice, o_orderkey) AS open, max_by(o_totalprice, o_orderkey) AS close
  FROM orders GROUP BY 1, 2)"""], _trailing("o_orderpriority, "))


ORACLE["vector_index_upkeep"] = """
SELECT vec_id, CAST(1 AS BIGINT) AS n, true AS in_place, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last
FROM embeddings"""


# What is merged from states equals what is computed from all quotes.
for _name in ("market_summary", "sector_stats", "concentration", "top_gainers"):
    ORACLE[f"{_name}_merged"] = ORACLE[_name]


def text(value: str) -> str:
    """A text as an SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def filled(template: str, **parts: str) -> str:
    """A ``{name}`` template as an SQL concatenation."""
    out, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [text(head), parts[name]]
    return " || ".join([*out, text(rest)])


# The snapshot's values, from the SQL of its pieces.
def _single(piece: str, query: str, fields: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{piece}' AS piece, 0 AS place, '{f}' AS name, CAST({f} AS DOUBLE) AS value FROM ({ORACLE[query]})" for f in fields)


def _listed(piece: str, query: str, name: str, value: str, order: str) -> str:
    return f"SELECT '{piece}', CAST(row_number() OVER (ORDER BY {order}) AS INTEGER), CAST({name} AS VARCHAR), CAST({value} AS DOUBLE) FROM ({ORACLE[query]})"


_LAST_BAR = with_([BARS_CTE], f"""
SELECT max_by(close, d) AS close, {r(mean("CASE WHEN open <> 0 THEN (close - open) / open * 100 END"), 2)} AS avg_change_pct FROM bars""")
ORACLE["_last_bar"] = _LAST_BAR
_AMOUNTS = with_([QUOTES_CTE], f"""
SELECT code, amount_num, {r("amount_num", 0)} AS amount FROM quotes WHERE amount_num IS NOT NULL ORDER BY amount_num DESC, code LIMIT 20""")
ORACLE["_amounts"] = _AMOUNTS
ORACLE["market_snapshot_values"] = " UNION ALL ".join([
    _single("spot_summary", "market_summary", ("up_count", "down_count", "flat_count", "total_count", "avg_change_pct", "std_change_pct", "total_amount")),
    _single("pe", "pe_percentile", ("current", "max", "min", "mean", "percentile")), _single("concentration", "concentration", ("top10_pct", "top50_pct")),
    _single("index_stats", "index_range_stats", ("close_min", "close_max", "close_avg", "volatility")), _single("index_stats", "_last_bar", ("close", "avg_change_pct")),
    _listed("top_gainers", "top_gainers", "code", "change_pct", "change_pct DESC, code"), _listed("top_losers", "top_losers", "code", "change_pct", "change_pct, code"),
    _listed("top_amount", "_amounts", "code", "amount", "amount_num DESC, code"), _listed("sector_stats", "sector_stats", "sector", "avg_change", "avg_change DESC, sector")])
del ORACLE["_last_bar"], ORACLE["_amounts"]

ORACLE["structured_parse_macro"] = """
WITH c AS (SELECT *, length(text) AS n FROM conversations),
s AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'not_json' WHEN n % 7 = 0 THEN 'missing' WHEN n % 3 = 0 THEN 'type' WHEN n % 130 > 100 THEN 'range' ELSE 'ok' END AS status FROM c)
SELECT conv_id, turn, status, CASE WHEN status = 'ok' THEN n / 8.0::DOUBLE END AS current_pe, CASE WHEN status = 'ok' THEN n END AS up_count,
       CASE WHEN status = 'ok' THEN n END AS n_signal FROM s"""

ORACLE["structured_parse_fund_flow"] = """
WITH c AS (SELECT *, length(text) AS n FROM conversations),
s AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'not_json' WHEN n % 7 = 0 THEN 'missing' WHEN n % 5 = 0 THEN 'type' WHEN n > 500 THEN 'range' ELSE 'ok' END AS status FROM c)
SELECT conv_id, turn, status, CASE WHEN status = 'ok' THEN n * 2.0::DOUBLE END AS amount, CASE WHEN status = 'ok' THEN n END AS n_name FROM s"""

ORACLE["structured_parse_editor"] = """
WITH c AS (SELECT *, length(text) AS n FROM conversations),
s AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'not_json' WHEN n % 7 = 0 THEN 'missing' WHEN n % 5 = 0 THEN 'type' ELSE 'ok' END AS status FROM c)
SELECT conv_id, turn, status, CASE WHEN status = 'ok' THEN 2 END AS n_highlights, CASE WHEN status = 'ok' THEN n END AS n_content FROM s"""

_ROW = lambda kind, brief, conf: filled(render.ANSWER_ROW, display=text(render.AGENT_DISPLAY[kind]), brief=brief, conf=conf)
ORACLE["render_whole_answer"] = f"""
WITH t AS (SELECT conv_id, arg_min(text, turn) AS summary, string_agg('**' || role || '**' || chr(10) || text || chr(10), chr(10) ORDER BY turn) AS sections,
             string_agg('- ' || text, chr(10) ORDER BY turn) FILTER (role = 'user') AS highlights FROM conversations GROUP BY conv_id),
c AS ({ORACLE["render_context"]})
SELECT conv_id, concat_ws(chr(10), {filled(render.ANSWER_HEAD, question="summary")},
    CASE WHEN conv_id % 3 <> 0 THEN {_ROW("fund_flow", "'in'", "'63%'")} ELSE {_ROW("fund_flow", text(render.ANSWER_FAILED), "'-'")} END || chr(10) || {_ROW("risk", "'r'", "'50%'")},
    '', {text(render.ANSWER_SYNTHESIS)},
    CASE WHEN conv_id % 4 = 0 THEN {text(render.ANSWER_NO_SYNTHESIS)} ELSE concat_ws(chr(10),
      {filled(render.ANSWER_JUDGEMENT, sentiment="'中性'", risk="'medium'")}, summary, '', sections, {text(render.ANSWER_HIGHLIGHTS)} || chr(10) || highlights) END,
    {text(render.ANSWER_NEWS)} || chr(10) || array_to_string(string_split(context, '---')[1:{render.NEWS_PARTS}], chr(10))) AS answer
FROM t JOIN c USING (conv_id)"""

ORACLE["embed_changed_only"] = ORACLE["embed_hash"]

# The query's and the documents' vectors of hashed bigrams, the ten nearest, their context.
ORACLE["retrieve_context"] = f"""
WITH kb AS (
  SELECT md5('doc/' || doc_id) AS id, substr(coalesce(text, ''), 1, 100) AS title, source, substr(coalesce(text, ''), 1, 100) || chr(10) || coalesce(text, '') AS document FROM documents),
texts AS (SELECT id, document AS t FROM kb WHERE length(document) >= 20 UNION ALL SELECT '' AS id, query AS t FROM ({ORACLE["search_query"]})),
p AS (SELECT id, list_transform(string_split(lower(trim(t)), ''), lambda c: unicode(c)::BIGINT) AS l FROM texts),
g AS (SELECT id, unnest(list_transform(range(1, len(l)), lambda i: (l[i] % 512 * 65599 + l[i + 1]) % 512)) AS b FROM p),
n AS (SELECT id, b, count(*) AS c FROM g GROUP BY id, b),
w AS (SELECT id, b, CAST(CAST(c / sqrt(CAST(sum(c * c) OVER (PARTITION BY id) AS DOUBLE)) AS FLOAT) AS DOUBLE) AS x FROM n),
sizes AS (SELECT id, sqrt(sum(x * x)) AS size FROM w GROUP BY id),
near AS (
  SELECT d.id, round(1 - sum(d.x * q.x) / (any_value(s.size) * (SELECT size FROM sizes WHERE id = '')), 12) AS dist
  FROM w d JOIN w q ON q.id = '' AND q.b = d.b AND d.id <> '' JOIN sizes s ON s.id = d.id GROUP BY d.id),
hits AS (SELECT *, row_number() OVER (ORDER BY dist, id) AS i FROM near QUALIFY i <= 10),
lines AS (SELECT i, {filled(render.CONTEXT_HIT, i="i", title="title", source="source", date="'20240101'", sim=pct0(r("greatest(0, 1 - dist)", 6)),
                            excerpt=f"substr(document, 1, {CONTEXT_EXCERPT_CHARS})")} AS line FROM hits JOIN kb USING (id))
SELECT 0 AS qid, {filled(render.CONTEXT_HEADER, n="count(*)")} || chr(10) || string_agg(line, chr(10) ORDER BY i) AS context FROM lines"""

_ASKED = {k: schemas.json_schema(v, structured.OPTIONAL.get(k, set())) for k, v in schemas.ANALYST_SCHEMAS.items()}
ORACLE["analyst_prompts"] = f"""
SELECT 0 AS qid, analyst, analyst || ' analyst' AS system,
       {filled(render.ANALYST_PROMPT, focus="focus", context="context", schema="CASE analyst " + " ".join(f"WHEN '{k}' THEN {text(v)}" for k, v in _ASKED.items()) + " END")} AS user
FROM ({ORACLE["focus_text"]}), ({ORACLE["retrieve_context"]})"""
