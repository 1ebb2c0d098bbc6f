"""Relational queries: scans, filters, joins, aggregates, windows, sorting, set operations, subqueries, recursion."""

from __future__ import annotations

from tessella.plans.registry import Registry

QUERIES = Registry()
q = QUERIES.sql

# TPC-H shapes
q("tpch_q1", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
 round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n
 FROM lineitem WHERE l_shipdate <= CAST('1998-09-02' AS TIMESTAMP) GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
q("tpch_q3", """SELECT o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 WHERE c_mktsegment = 'BUILDING' AND o_orderdate < CAST('1998-01-01' AS TIMESTAMP) GROUP BY o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 10""")
q("tpch_q5", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
 WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name""")
q("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
q("tpch_q10", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
q("tpch_q12", """SELECT o_orderpriority, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS f_lines, sum(CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END) AS o_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority""",
  "SELECT o_orderpriority, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f_lines, CAST(sum(CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END) AS BIGINT) AS o_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority")

# scans, projections, filters
q("scan_project", "SELECT p_partkey, p_name, p_size FROM part")
q("scan_pruned_filter", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 49")
q("select_star_qualified", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
q("filter_and_or_not", "SELECT p_partkey FROM part WHERE (p_size > 40 OR p_size < 5) AND NOT p_brand = 'Brand#11'")
q("filter_between", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000")
q("filter_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
q("filter_not_in_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, NULL)")
q("filter_like", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE '%1_' AND c_name NOT LIKE '%9%'")
q("filter_is_null", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE nullif(l_discount, 0.0) IS NULL AND l_quantity = 1")
q("filter_three_valued", "SELECT count(*) AS n FROM lineitem WHERE NOT (nullif(l_discount, 0.0) > 0.05)")
q("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS state FROM orders")
q("case_searched", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part")
q("cast_try", "SELECT p_partkey, CAST(p_name AS INT) AS as_int, CAST('12' AS INT) AS twelve FROM part", "SELECT p_partkey, TRY_CAST(p_name AS INT) AS as_int, 12 AS twelve FROM part")
q("concat_op", "SELECT n_nationkey, n_name || '-' || n_regionkey AS tag FROM nation")
q("distinct_rows", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
q("dual_scan", "SELECT 1 AS one, 'a' AS a")
q("derived_table", "SELECT s, n FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE n > 10")
q("quoted_identifiers", 'SELECT n_name AS "Name", n_nationkey AS "Key" FROM nation')
q("comments_nested", "SELECT r_name /* outer /* inner */ still */ FROM region -- end")
# joins
q("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
q("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') o ON c_custkey = o.o_custkey")
q("join_right", "SELECT n_name, s_suppkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
q("join_full", "SELECT a.c_custkey AS a_key, b.c_custkey AS b_key FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 12) a FULL OUTER JOIN (SELECT c_custkey FROM customer WHERE c_nationkey > 8) b ON a.c_custkey = b.c_custkey")
q("join_cross", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b")
q("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
q("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey > b.n_nationkey AND a.n_regionkey < b.n_regionkey")
q("join_multi_cond", "SELECT l_orderkey, s_suppkey, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey AND l_quantity > 45 AND s_acctbal > 0")
q("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
q("join_natural", "SELECT r_name, n FROM region NATURAL JOIN (SELECT n_regionkey AS r_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) t")
q("join_using", "SELECT r_regionkey, r_name, n_name FROM region JOIN (SELECT n_regionkey AS r_regionkey, n_name FROM nation) n USING (r_regionkey)")
q("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 100000)")
q("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
q("join_three_way", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 50000")
q("join_five_way", "SELECT n_name, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
q("join_subquery", "SELECT c_name, t.n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON c_custkey = t.o_custkey")
q("join_null_keys", "SELECT count(*) AS n FROM (SELECT nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 0) AS k FROM region) b ON a.k = b.k")
# aggregates
for name, expr, oracle in (
    ("count_star", "count(*)", ""), ("count_col", "count(nullif(l_discount, 0.0))", ""), ("count_distinct", "count(DISTINCT l_partkey)", ""), ("sum", "round(sum(l_extendedprice), 2)", ""),
    ("sum_int", "sum(l_linenumber)", "CAST(sum(l_linenumber) AS BIGINT)"), ("sum_distinct", "sum(DISTINCT l_linenumber)", "CAST(sum(DISTINCT l_linenumber) AS BIGINT)"), ("avg", "round(avg(l_quantity), 4)", ""), ("avg_distinct", "avg(DISTINCT l_linenumber)", ""),
    ("min", "min(l_shipdate)", ""), ("max", "max(l_extendedprice)", ""), ("stddev", "round(stddev(l_quantity), 6)", ""), ("stddev_pop", "round(stddev_pop(l_quantity), 6)", ""), ("variance", "round(variance(l_quantity), 5)", ""),
    ("var_pop", "round(var_pop(l_quantity), 5)", ""), ("median", "median(l_quantity)", ""), ("percentile_cont", "percentile_cont(l_extendedprice)", "quantile_cont(l_extendedprice, 0.5)"),
    ("percentile_disc", "percentile_disc(l_quantity)", "quantile_disc(l_quantity, 0.5)"), ("approx_count_distinct", "abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey)", "true"),
    ("approx_percentile", "abs(approx_percentile(l_quantity) - median(l_quantity)) <= 1", "true"), ("array_agg", "array_join(array_sort(array_agg(DISTINCT l_linenumber)), '-')", "array_to_string(list_sort(array_agg(DISTINCT l_linenumber)), '-')"),
    ("grouping", "grouping(l_returnflag) + 0 * count(*)", "CAST(0 AS BIGINT)"), ("count_distinct_fn", "count_distinct(l_suppkey)", "count(DISTINCT l_suppkey)"),
):
    q(f"agg_{name}", f"SELECT l_returnflag, {expr} AS v FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {oracle or expr} AS v FROM lineitem GROUP BY l_returnflag")
q("agg_mode", "SELECT l_returnflag, mode(l_linenumber) AS v FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, v FROM (SELECT l_returnflag, v, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, v) AS k FROM (SELECT l_returnflag, l_linenumber AS v, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE k = 1")
q("agg_string_agg", "SELECT n_regionkey, array_join(array_sort(split(string_agg(n_name, '|'), '|')), '|') AS v FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS v FROM nation GROUP BY n_regionkey")
q("agg_approx_top_k", "SELECT array_join(array_sort(approx_top_k(c_mktsegment, 5)), ',') AS v FROM customer", "SELECT string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS v FROM (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC LIMIT 5)")
q("group_by_expr", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY 1")
q("group_by_ordinal_alias", "SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY s, 2")
q("group_by_null_key", "SELECT nullif(o_orderstatus, 'P') AS s, count(*) AS n FROM orders GROUP BY nullif(o_orderstatus, 'P')")
q("having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 55")
q("having_hidden_agg", "SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING avg(c_acctbal) > 4500")
q("scalar_agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, max(l_shipdate) AS m FROM lineitem WHERE l_quantity < 0")
q("agg_case_inside", "SELECT l_linestatus, sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS big FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, CAST(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM lineitem GROUP BY l_linestatus")
q("agg_order_by_agg", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment")
q("agg_filter_clause", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 10000) AS n FROM orders GROUP BY o_orderstatus")
q("agg_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
# windows
W = "PARTITION BY o_custkey ORDER BY o_orderkey"
for name, expr, oracle in (
    ("row_number", f"row_number() OVER ({W})", ""), ("rank", "rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)", ""), ("dense_rank", "dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority)", ""),
    ("ntile", f"ntile(4) OVER ({W})", ""), ("percent_rank", f"round(percent_rank() OVER ({W}), 6)", ""), ("cume_dist", f"round(cume_dist() OVER ({W}), 6)", ""), ("lag_default", f"lag(o_orderkey, 1, 0) OVER ({W})", ""), ("lead", f"lead(o_orderkey, 2) OVER ({W})", ""),
    ("first_value", f"first_value(o_orderkey) OVER ({W})", ""), ("last_value", f"last_value(o_orderkey) OVER ({W})", f"last_value(o_orderkey) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), ("nth_value", f"nth_value(o_orderkey, 2) OVER ({W})", ""),
    ("sum_running", f"round(sum(o_totalprice) OVER ({W}), 2)", f"round(sum(o_totalprice) OVER ({W} ROWS UNBOUNDED PRECEDING), 2)"), ("avg_partition", "avg(o_orderkey) OVER (PARTITION BY o_custkey)", ""),
    ("count_sliding", f"count(*) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)", ""), ("min_sliding", f"min(o_totalprice) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", ""), ("max_sliding", f"max(o_totalprice) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", ""),
    ("median_sliding", f"median(o_totalprice) OVER ({W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", ""), ("range_frame", "count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)", ""),
    ("order_nulls", "row_number() OVER (PARTITION BY o_orderstatus ORDER BY nullif(o_orderpriority, '1-URGENT') DESC, o_orderkey)", "row_number() OVER (PARTITION BY o_orderstatus ORDER BY nullif(o_orderpriority, '1-URGENT') DESC NULLS FIRST, o_orderkey)"),
):
    kind = "BIGINT" if name in ("row_number", "rank", "dense_rank", "ntile", "count_sliding", "range_frame", "order_nulls") else ""
    shown = lambda e, k=kind: f"CAST({e} AS {k})" if k else e
    q(f"win_{name}", f"SELECT o_orderkey, {shown(expr)} AS v FROM orders", f"SELECT o_orderkey, {shown(oracle or expr)} AS v FROM orders")
q("win_multi_spec", f"SELECT o_orderkey, CAST(row_number() OVER ({W}) AS BIGINT) AS a, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS b, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders")
# sort, limit
q("topk_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
q("limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30")
q("order_nulls_last", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY nullif(o_orderstatus, 'F') NULLS LAST, o_orderkey LIMIT 200")
q("order_nulls_first", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY nullif(o_orderstatus, 'F') DESC, o_orderkey LIMIT 200", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY 2 DESC NULLS FIRST, o_orderkey LIMIT 200")
q("order_by_ordinal", "SELECT n_name, n_nationkey FROM nation ORDER BY 2 DESC LIMIT 7")
q("order_by_expr", "SELECT p_partkey FROM part ORDER BY p_size * -1, p_partkey LIMIT 15")
q("limit_zero", "SELECT n_name FROM nation LIMIT 0")
# set operations
A, B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 3000", "SELECT s_nationkey AS k FROM supplier"
for name, op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    q(name, f"{A} {op} {B}")
q("setop_chain", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region INTERSECT SELECT n_regionkey FROM nation WHERE n_regionkey > 2")
q("setop_order_limit", f"{A} UNION {B} ORDER BY k LIMIT 5")
# subqueries, common table expressions
q("sub_scalar", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
q("sub_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
q("sub_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 20000)")
q("sub_correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
q("sub_nested", "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > (SELECT min(r_regionkey) FROM region))")
q("cte_simple", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 30000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
q("cte_multi", "WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT r_regionkey, r_name FROM region) SELECT r_name, count(*) AS n FROM a JOIN b ON n_regionkey = r_regionkey GROUP BY r_name")
q("cte_columns", "WITH t (k, v) AS (SELECT n_nationkey, n_name FROM nation) SELECT k, v FROM t WHERE k < 5")
q("cte_reused", "WITH t AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT a.c_nationkey, a.n FROM t a JOIN (SELECT max(n) AS m FROM t) b ON a.n = b.m")
q("rcte_counter", "WITH RECURSIVE c (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 200) SELECT n FROM c")
q("rcte_fibonacci", "WITH RECURSIVE f (a, b) AS (SELECT 0, 1 UNION ALL SELECT b, a + b FROM f WHERE b < 1000) SELECT a, b FROM f")
q("rcte_union_distinct", "WITH RECURSIVE c (n) AS (SELECT 0 UNION SELECT (n + 3) % 7 FROM c) SELECT n FROM c")
q("rcte_reach", "WITH RECURSIVE r (a) AS (SELECT 0 UNION SELECT (n_nationkey * 7 + r.a) % 25 FROM nation JOIN r ON n_regionkey = r.a % 5) SELECT a FROM r")
# table functions
q("tf_generate_series", "SELECT g FROM generate_series(3, 12) AS g", "SELECT unnest(generate_series(3, 12)) AS g")
q("tf_generate_series_step", "SELECT g FROM generate_series(20, 1, -4) AS g", "SELECT unnest(generate_series(20, 1, -4)) AS g")
q("tf_generate_series_empty", "SELECT g FROM generate_series(5, 1) AS g", "SELECT unnest(generate_series(5, 1)) AS g")
q("tf_series_join", "SELECT g, count(n_name) AS n FROM generate_series(0, 6) AS g LEFT JOIN nation ON n_regionkey = g GROUP BY g", "SELECT g, count(n_name) AS n FROM (SELECT unnest(generate_series(0, 6)) AS g) LEFT JOIN nation ON n_regionkey = g GROUP BY g")
q("tf_explode", "SELECT p_partkey, explode(split(p_name, ' ')) AS w FROM part", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part")
q("tf_posexplode", "SELECT p_partkey, posexplode(split(p_name, ' ')) AS (pos, w) FROM part", "SELECT p_partkey, CAST(unnest(range(len(string_split(p_name, ' ')))) AS INT) AS pos, unnest(string_split(p_name, ' ')) AS w FROM part")
q("tf_unnest_split", "SELECT w, count(*) AS n FROM (SELECT unnest(split(p_name, ' ')) AS w FROM part) t GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")

# types of derived columns
q("div_derived", "SELECT x / 2 AS v, x % 4 AS m FROM (SELECT n_nationkey AS x FROM nation) t", "SELECT x // 2 AS v, x % 4 AS m FROM (SELECT n_nationkey AS x FROM nation) t")
q("div_cte", "WITH t (n) AS (SELECT l_linenumber FROM lineitem), u AS (SELECT n + 1 AS k FROM t) SELECT k / 2 AS v, count(*) AS c FROM u GROUP BY k / 2",
  "SELECT (l_linenumber + 1) // 2 AS v, count(*) AS c FROM lineitem GROUP BY 1")
q("div_scalar_subquery", "SELECT (SELECT 7) / 2 AS v, (SELECT max(n_nationkey) FROM nation) / 2 AS w", "SELECT 7 // 2 AS v, (SELECT max(n_nationkey) FROM nation) // 2 AS w")
q("div_ambiguous", "SELECT a.k / 2 AS v, b.k / 2 AS w FROM (SELECT n_nationkey AS k FROM nation) a JOIN (SELECT r_regionkey + 0.5 AS k, r_regionkey AS r FROM region) b ON a.k = b.r",
  "SELECT r_regionkey // 2 AS v, (r_regionkey + CAST(0.5 AS DOUBLE)) / 2 AS w FROM region")
q("div_correlated", "SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n.n_nationkey / 6)", "SELECT n_name FROM nation WHERE n_nationkey // 6 IN (SELECT r_regionkey FROM region)")
q("bool_derived", "SELECT b + 1 AS v FROM (SELECT n_nationkey > 3 AS b FROM nation) t", "SELECT CAST(n_nationkey > 3 AS INT) + 1 AS v FROM nation")
q("rcte_deep", "WITH RECURSIVE c (n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 900), d AS (SELECT n / 2 AS h FROM c) SELECT h, count(*) AS k FROM d GROUP BY h",
  "SELECT CAST(n // 2 AS INT) AS h, count(*) AS k FROM (SELECT unnest(generate_series(1, 900)) AS n) GROUP BY 1")
q("win_percentile_cont", "SELECT n_nationkey, percentile_cont(n_nationkey, 0.9) OVER (ORDER BY n_nationkey) AS v FROM nation", "SELECT n_nationkey, quantile_cont(CAST(n_nationkey AS DOUBLE), 0.9) OVER (ORDER BY n_nationkey ROWS UNBOUNDED PRECEDING) AS v FROM nation")
q("agg_approx_top_k_nulls", "SELECT array_join(approx_top_k(nullif(n_regionkey % 2, 1), 2), ',') AS v FROM nation", "SELECT '0' AS v")
q("date_trunc_of_date", "SELECT date_trunc('MONTH', CAST(o_orderdate AS DATE)) AS v, count(*) AS n FROM orders GROUP BY 1", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS v, count(*) AS n FROM orders GROUP BY 1")
