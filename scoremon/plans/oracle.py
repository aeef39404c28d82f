"""SQL text of the derived views, shared by all oracles.

The SQL is written independently of the DataFrame code: plain joins, window
functions and sub-queries, one statement per query.
"""

from __future__ import annotations

APP_BASE = """app_base AS (
 SELECT o.o_orderkey AS app_id, o.o_custkey AS client_id,
  CAST(year(o.o_orderdate)*100+month(o.o_orderdate) AS INT) AS codmes,
  CAST(year(o.o_orderdate)*12+month(o.o_orderdate)-1 AS INT) AS month_idx,
  o.o_totalprice AS amount, c.c_acctbal AS income, c.c_mktsegment AS job_type,
  CASE WHEN o.o_orderpriority='1-URGENT' THEN '1. Affluent'
       WHEN o.o_orderpriority IN ('2-HIGH','3-MEDIUM') THEN '2. Consumer'
       ELSE '3. Rest' END AS segment,
  CASE WHEN o.o_orderstatus='P' AND o.o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS def_at_origin,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL
       ELSE -3.5 + 0.6*COALESCE(l.n_ret,0) - 0.0001*c.c_acctbal END AS xb,
  l.dist AS dist_def
 FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey
 LEFT JOIN (
  SELECT l_orderkey,
   CAST(SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS INT) AS n_ret,
   CAST(MIN(CASE WHEN l_returnflag='R' AND l_shipdate>o_orderdate
       THEN (year(l_shipdate)-year(o_orderdate))*12+month(l_shipdate)-month(o_orderdate) END) AS INT) AS dist
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY l_orderkey) l
 ON l.l_orderkey=o.o_orderkey)"""

SCORED = """scored AS (
 SELECT *, 1/(1+exp(-xb)) AS pd, 174.25 - 57.708*xb AS score FROM app_base)"""

APP_EXT = """app_ext AS (
 SELECT app_id, codmes, client_id, xb + 0.25 AS xb_alt,
  CASE WHEN app_id % 23 = 0 THEN CAST(1111111111.0 AS DOUBLE)
       WHEN app_id % 29 = 0 THEN CAST(-2222222222.0 AS DOUBLE)
       ELSE floor(income)/100 END AS debt_raw
 FROM app_base WHERE app_id % 5 <> 0
 UNION ALL
 SELECT app_id, codmes, client_id, xb + 0.25,
  CASE WHEN app_id % 23 = 0 THEN CAST(1111111111.0 AS DOUBLE)
       WHEN app_id % 29 = 0 THEN CAST(-2222222222.0 AS DOUBLE)
       ELSE floor(income)/100 END
 FROM app_base WHERE app_id % 50 = 1)"""

PANEL = """panel AS (
 SELECT client_id, month_idx, max(codmes) AS codmes,
  sum(CAST(amount AS DECIMAL(18,2))) AS balance,
  max(CASE WHEN dist_def<=3 THEN 30*(4-dist_def) ELSE 0 END) AS days_late
 FROM app_base GROUP BY client_id, month_idx)"""

EVAL_LOG = """eval_log AS (
 SELECT client_id AS req_id, codmes AS run_month, segment AS district, app_id FROM app_base)"""

GEO_RULES = """geo_rules AS (
 SELECT r_name AS region, CAST(NULL AS VARCHAR) AS nation, 'HIGH' AS risk
 FROM region WHERE r_name IN ('AFRICA')
 UNION ALL SELECT r_name, 'NATION_2', 'HIGH' FROM region WHERE r_name = 'ASIA'
 UNION ALL SELECT r_name, 'NATION_7', 'HIGH' FROM region WHERE r_name = 'ASIA'
 UNION ALL SELECT r_name, 'NATION_3', 'LOW' FROM region WHERE r_name = 'EUROPE')"""


def base(select: str, *views: str) -> str:
    """A statement over ``app_base`` and further views."""
    text = select.strip()
    views = ",\n".join([APP_BASE, *views])
    return f"WITH {views}\n{text}"


def scored(select: str, *views: str) -> str:
    """A statement over the scored base and further views."""
    return base(select, SCORED, *views)
