"""Relational queries: SQL over the tables as views, the same text for both engines unless they differ."""

from __future__ import annotations

import re

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# name -> text, or (text for Spark, text for DuckDB or None)
SQL: dict[str, str | tuple[str, str | None]] = {
    "join_inner": "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey",
    "join_right": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_full": "SELECT c_custkey, o_orderkey FROM customer FULL JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'",
    "join_semi": ("SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "join_anti": ("SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey",
    "join_range": "SELECT s_suppkey, lo, hi FROM supplier JOIN (VALUES (0, 2500), (2500, 5000), (5000, 7500), (7500, 10000)) AS t(lo, hi) ON s_acctbal >= lo AND s_acctbal < hi",
    "agg_group": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts FROM lineitem GROUP BY l_returnflag",
    "agg_having": "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 15",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "agg_filter": "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_open, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS closed FROM orders GROUP BY o_orderpriority",
    "agg_pivot": ("SELECT * FROM (SELECT o_orderpriority, o_orderstatus FROM orders) PIVOT (count(*) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS o, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS p FROM orders GROUP BY o_orderpriority"),
    "agg_approx_distinct": ("SELECT o_orderpriority, abs(approx_count_distinct(o_custkey, 0.02) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS near FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, true AS near FROM orders GROUP BY o_orderpriority"),
    "agg_percentile": ("SELECT o_orderpriority, round(percentile(o_totalprice, 0.5), 2) AS p50 FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.5), 2) AS p50 FROM orders GROUP BY o_orderpriority"),
    "win_row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "win_rank_dense": "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS d FROM orders",
    "win_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 1, -1.0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_value FROM events",
    "win_running_sum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS running FROM events",
    "win_frame_rows": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS near FROM events",
    "win_frame_range": "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS BIGINT) AS n FROM orders",
    "win_ntile": "SELECT o_orderkey, CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quarter FROM orders",
    "win_first_last": "SELECT event_id, first_value(event_id) OVER w AS first_id, last_value(event_id) OVER w AS last_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sort_multi": "SELECT o_orderpriority, o_orderdate, o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "set_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "set_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "subquery_scalar": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)",
    "subquery_correlated": "SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), named AS (SELECT c_name, total FROM big JOIN customer ON c_custkey = o_custkey) SELECT c_name, round(total, 2) AS total FROM named WHERE total > 3000000",
    "fn_string": "SELECT c_custkey, upper(c_name) AS u, substring(c_name, 1, 8) AS head, replace(c_mktsegment, 'E', '_') AS r, length(c_name) AS n, concat(c_name, '/', c_mktsegment) AS joined, reverse(c_mktsegment) AS rev, lpad(c_mktsegment, 12, '*') AS padded FROM customer",
    "fn_date": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, date_format(o_orderdate, 'yyyy-MM-dd') AS iso, CAST(date_add(to_date(o_orderdate), 30) AS STRING) AS due FROM orders", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(quarter(o_orderdate) AS INT) AS q, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due FROM orders"),
    "fn_math": "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice + 1), 6) AS l, abs(o_custkey - 500) AS a, o_custkey % 7 AS m, sign(o_totalprice - 100000) AS s, CAST(floor(o_totalprice / 1000) AS BIGINT) AS f FROM orders",
    "fn_array": ("SELECT vec_id, size(embedding) AS n, round(CAST(embedding[0] AS DOUBLE), 5) AS first, round(aggregate(embedding, 0D, (a, x) -> a + x), 4) AS total, size(filter(embedding, x -> x > 0)) AS positive FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS positive FROM embeddings"),
    "fn_map": ("SELECT o_orderstatus, map_from_entries(collect_list(struct(o_orderpriority, n)))['1-URGENT'] AS urgent FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS urgent FROM orders GROUP BY o_orderstatus"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k + 1 AS k1 FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k1 FROM events"),
    "fn_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'P'), '?') AS status FROM orders",
    "fn_regex": ("SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, length(html) AS n FROM pages", "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, CAST(length(html) AS INT) AS n FROM pages"),
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY 1, 2",
    "tpch_q3": "SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey WHERE r_regionkey = 2 GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "tpch_q10": "SELECT c_custkey, c_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
}


def register(spark, sf_dir: str, names=TABLES) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def run(text: str):
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def query(spark, sf_dir: str):
        register(spark, sf_dir, used)
        return spark.sql(text)

    query.__doc__ = text
    return query


QUERIES = {name: run(text if isinstance(text, str) else text[0]) for name, text in SQL.items()}
ORACLES = {name: text if isinstance(text, str) else text[1] for name, text in SQL.items() if isinstance(text, str) or text[1]}
