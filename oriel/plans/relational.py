"""Scans, predicates, joins, aggregates, windows, order, sets, common tables and hierarchies."""

from __future__ import annotations

from .base import Registry

R = Registry()
q = R.add

# scans
q("scan_table", "SELECT n_nationkey, n_name FROM nation")
q("scan_alias", "SELECT x.n_name FROM nation x")
q("scan_comma_join", "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
q("scan_view", "SELECT o_orderkey, o_totalprice FROM v_big_orders WHERE o_custkey > 100", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_custkey > 100")
q("scan_subquery", "SELECT d.o_orderstatus, d.total FROM (SELECT o_orderstatus, COUNT(*) AS total FROM orders GROUP BY o_orderstatus) d")
q("scan_lateral", "SELECT n.n_name, x.c FROM nation n, LATERAL (SELECT COUNT(*) AS c FROM customer c WHERE c.c_nationkey = n.n_nationkey) x")
q("scan_unnest", "SELECT e.vec_id, t.column_value AS v FROM embeddings e, TABLE(e.embedding) t", "SELECT vec_id, unnest(embedding) AS v FROM embeddings")
q("scan_json_table", "SELECT e.event_id, j.k FROM events e, JSON_TABLE(e.props, '$' COLUMNS (k INTEGER PATH '$.k')) j", "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
q("scan_sample", "SELECT o_orderkey FROM orders SAMPLE (10) SEED (42)", rows_only=True)
q("scan_dual", "SELECT n.n_nationkey, d.one, d.x FROM nation n, (SELECT 1 AS one, 'x' AS x FROM dual) d", "SELECT n_nationkey, 1 AS one, 'x' AS x FROM nation")
# projections and predicates
q("proj_columns", "SELECT c_name AS name, c_acctbal * 2 AS twice FROM customer")
q("proj_star", "SELECT * FROM region")
q("proj_table_star", "SELECT n.*, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
q("proj_distinct", "SELECT UNIQUE o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
q("filter_basic", "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000")
q("pred_and_or", "SELECT c_custkey FROM customer WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR c_nationkey = 3")
q("pred_not", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0)")
q("pred_is_null", "SELECT c_custkey FROM customer WHERE NULLIF(c_mktsegment, 'BUILDING') IS NULL AND c_name IS NOT NULL")
q("pred_is_nan", "SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NAN AND c_acctbal < 0", "SELECT c_custkey FROM customer WHERE NOT isnan(c_acctbal) AND c_acctbal < 0")
q("pred_is_empty", "SELECT vec_id FROM embeddings e WHERE e.embedding IS NOT EMPTY", "SELECT vec_id FROM embeddings WHERE len(embedding) > 0")
q("pred_compare", "SELECT o_orderkey FROM orders WHERE o_orderstatus ^= 'F' AND o_totalprice >= 1000 AND o_custkey != 7", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice >= 1000 AND o_custkey <> 7")
q("pred_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
q("pred_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
q("pred_not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
q("pred_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08")
q("pred_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%1%' AND p_type NOT LIKE 'X_%'")
q("pred_like_escape", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'")
q("pred_ilike", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation_1%'")
q("pred_exists", "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
q("pred_not_exists", "SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
q("pred_any", "SELECT o_orderkey FROM orders WHERE o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_totalprice > SOME (100000, 200000)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_totalprice > 100000")
q("pred_all", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')")
q("pred_scalar_subquery", "SELECT c.c_custkey, (SELECT MAX(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
q("expr_arith", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * (1 - l_discount) + l_tax / 2, 4) AS x FROM lineitem")
q("expr_mod_pow", "SELECT n_nationkey MOD 7 AS m, 2 ** 3 AS p, MOD(n_nationkey, 4) AS k FROM nation", "SELECT n_nationkey % 7 AS m, power(2, 3)::DOUBLE AS p, n_nationkey % 4 AS k FROM nation")
q("expr_concat", "SELECT n_name || '-' || NULLIF(n_name, 'NATION_3') AS c FROM nation")
q("expr_unary_minus", "SELECT -ABS(c_acctbal) AS neg, +c_custkey AS pos FROM customer")
q("expr_at_time_zone", "SELECT o_orderkey, o_orderdate AT TIME ZONE 'Asia/Tokyo' AS tokyo FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 9 HOUR AS tokyo FROM orders")
q("expr_collate", "SELECT c_custkey FROM customer WHERE LOWER(c_mktsegment) COLLATE BINARY_CI = 'BUILDING'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
q("expr_interval", "SELECT o_orderkey FROM orders WHERE o_orderdate < DATE '1995-01-31' + INTERVAL '3' DAY")
q("expr_case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS size_class FROM orders")
q("expr_case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
q("expr_literals", "SELECT r_regionkey, 1 AS i, 'it''s ' || r_name AS s, TRUE AS b, NULLIF(1, 1) AS n, q'[a'b]' || r_name AS qs FROM region", "SELECT r_regionkey, 1 AS i, 'it''s ' || r_name AS s, TRUE AS b, NULLIF(1, 1) AS n, 'a''b' || r_name AS qs FROM region")
q("expr_dates", "SELECT o_orderkey, o_orderdate + 30 AS later, o_orderdate - DATE '1990-01-01' AS days FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS later, (epoch(o_orderdate) - epoch(TIMESTAMP '1990-01-01'))::DOUBLE / 86400 AS days FROM orders")
# joins
q("join_inner", "SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
q("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 250000")
q("join_right", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
q("join_full", "SELECT l.doc_id AS a, d.doc_id AS b FROM (SELECT doc_id FROM labels WHERE quality = 1) l FULL OUTER JOIN (SELECT doc_id FROM labels WHERE toxic = 1) d ON l.doc_id = d.doc_id")
q("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
q("join_natural", "SELECT doc_id, lang, quality FROM documents NATURAL JOIN labels", "SELECT d.doc_id, lang, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
q("join_using", "SELECT doc_id, source, toxic FROM documents JOIN labels USING (doc_id)")
q("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
q("join_range", "SELECT s.s_suppkey, b.lo FROM supplier s JOIN (SELECT -1000 AS lo, 3000 AS hi FROM dual UNION ALL SELECT 3000, 7000 FROM dual UNION ALL SELECT 7000, 20000 FROM dual) b ON s.s_acctbal >= b.lo AND s.s_acctbal < b.hi", "SELECT s.s_suppkey, b.lo FROM supplier s JOIN (SELECT -1000 AS lo, 3000 AS hi UNION ALL SELECT 3000, 7000 UNION ALL SELECT 7000, 20000) b ON s.s_acctbal >= b.lo AND s.s_acctbal < b.hi")
q("join_cross_apply", "SELECT r.r_name, x.n FROM region r CROSS APPLY (SELECT COUNT(*) AS n FROM nation n WHERE n.n_regionkey = r.r_regionkey) x", "SELECT r.r_name, x.n FROM region r, LATERAL (SELECT COUNT(*) AS n FROM nation n WHERE n.n_regionkey = r.r_regionkey) x")
q("join_outer_apply", "SELECT c.c_custkey, x.o_orderkey FROM customer c OUTER APPLY (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) x", "SELECT c.c_custkey, x.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000) x ON true")
q("join_partition_outer", "SELECT f.o_orderstatus, d.p, COALESCE(f.n, 0) AS n FROM (SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY o_orderstatus, o_orderpriority) f PARTITION BY (o_orderstatus) RIGHT OUTER JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) d ON f.o_orderpriority = d.p", "WITH f AS (SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY ALL), d AS (SELECT DISTINCT o_orderpriority AS p FROM orders) SELECT k.o_orderstatus, d.p, COALESCE(f.n, 0) AS n FROM (SELECT DISTINCT o_orderstatus FROM f) k CROSS JOIN d LEFT JOIN f ON f.o_orderstatus = k.o_orderstatus AND f.o_orderpriority = d.p")
q("join_oracle_plus", "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c, orders o, nation n WHERE c.c_custkey = o.o_custkey(+) AND o.o_totalprice(+) > 200000 AND c.c_nationkey = n.n_nationkey", "SELECT c.c_custkey, o.o_orderkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
q("join_semi", "SELECT s_suppkey FROM supplier s WHERE (s.s_nationkey, 1) IN (SELECT c_nationkey, 1 FROM customer WHERE c_acctbal > 5000)", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)")
q("join_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
q("join_self", "SELECT a.conv_id, a.turn, b.role AS next_role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
# aggregates
q("agg_count", "SELECT COUNT(*) AS n, COUNT(NULLIF(o_orderstatus, 'F')) AS m FROM orders")
q("agg_sum_avg_min_max", "SELECT ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_orderdate) AS lo, MAX(o_custkey) AS hi FROM orders")
q("agg_distinct", "SELECT COUNT(DISTINCT o_custkey) AS c, SUM(DISTINCT l) AS s FROM (SELECT o_custkey, o_custkey MOD 10 AS l FROM orders)", "SELECT COUNT(DISTINCT o_custkey) AS c, CAST(SUM(DISTINCT o_custkey % 10) AS BIGINT) AS s FROM orders")
q("agg_group_by", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
q("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders HAVING COUNT(*) > 12 GROUP BY o_custkey", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
q("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
q("agg_rollup", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP(o_orderstatus, o_orderpriority)")
q("agg_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(GROUPING(l_returnflag) AS INTEGER) AS g FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)")
q("agg_global", "SELECT MAX(l_quantity) AS hi, MIN(l_quantity) AS lo FROM lineitem")
q("agg_listagg", "SELECT n_regionkey, LISTAGG(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names FROM nation GROUP BY n_regionkey")
q("agg_stats", "SELECT o_orderstatus, ROUND(MEDIAN(o_totalprice), 4) AS med, ROUND(STDDEV(o_totalprice), 2) AS sd, ROUND(VAR_POP(o_totalprice) / 1000000, 2) AS vp, ROUND(CORR(o_totalprice, o_custkey), 6) AS c FROM orders GROUP BY o_orderstatus")
q("agg_regr", "SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2, REGR_COUNT(l_extendedprice, l_quantity) AS n, ROUND(COVAR_POP(l_extendedprice, l_quantity), 2) AS cp FROM lineitem", "SELECT ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2, CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n, ROUND(COVAR_POP(l_extendedprice, l_quantity), 2) AS cp FROM lineitem")
q("agg_percentile", "SELECT o_orderstatus, ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90, PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS p50 FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, ROUND(quantile_cont(o_totalprice, 0.9), 4) AS p90, quantile_disc(o_totalprice, 0.5) AS p50 FROM orders GROUP BY o_orderstatus")
q("agg_collect", "SELECT n_regionkey, COLLECT(n_nationkey) AS ks FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS ks FROM nation GROUP BY n_regionkey")
q("agg_wm_concat", "SELECT r_regionkey, WM_CONCAT(r_name) AS names FROM region GROUP BY r_regionkey", "SELECT r_regionkey, r_name AS names FROM region")
q("agg_json", "SELECT n_regionkey, JSON_ARRAYAGG(n_nationkey ORDER BY n_nationkey) AS a, JSON_OBJECTAGG(KEY n_name VALUE n_nationkey) AS o FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey) || ']' AS a, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS o FROM nation GROUP BY n_regionkey")
q("agg_keep", "SELECT o_custkey, MIN(o_totalprice) KEEP (DENSE_RANK FIRST ORDER BY o_orderdate) AS first_price FROM orders GROUP BY o_custkey", "SELECT o_custkey, MIN(o_totalprice) AS first_price FROM orders o WHERE o_orderdate = (SELECT MIN(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey) GROUP BY o_custkey")
# windows
W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
q("win_row_number", f"SELECT o_orderkey, ROW_NUMBER() {W} AS rn FROM orders", f"SELECT o_orderkey, CAST(ROW_NUMBER() {W} AS INTEGER) AS rn FROM orders")
q("win_rank", "SELECT l_orderkey, l_linenumber, RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(RANK() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS INTEGER) AS r FROM lineitem")
q("win_dense_rank", "SELECT o_orderkey, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders", "SELECT o_orderkey, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS r FROM orders")
q("win_first_last", f"SELECT o_orderkey, FIRST_VALUE(NULLIF(o_orderstatus, 'F') IGNORE NULLS) {W} AS f, LAST_VALUE(NULLIF(o_orderstatus, 'F')) IGNORE NULLS {W} AS l FROM orders", f"SELECT o_orderkey, FIRST_VALUE(NULLIF(o_orderstatus, 'F') IGNORE NULLS) {W} AS f, LAST_VALUE(NULLIF(o_orderstatus, 'F') IGNORE NULLS) {W} AS l FROM orders")
q("win_lag_lead", "SELECT conv_id, turn, LAG(role, 1, 'none') OVER (PARTITION BY conv_id ORDER BY turn) AS before, LEAD(role) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations")
q("win_aggregates", f"SELECT o_orderkey, ROUND(SUM(o_totalprice) {W}, 2) AS s, COUNT(*) {W} AS c, MAX(o_totalprice) {W} AS m FROM orders")
q("win_ntile", "SELECT o_orderkey, NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS t FROM orders", "SELECT o_orderkey, CAST(NTILE(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS t FROM orders")
q("win_percent_rank_cume_dist", "SELECT o_orderkey, ROUND(PERCENT_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 8) AS p, ROUND(CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 8) AS c FROM orders")
q("win_nth_value", f"SELECT o_orderkey, NTH_VALUE(o_totalprice, 2) {W} AS v FROM orders")
q("win_ratio_to_report", "SELECT o_orderkey, ROUND(RATIO_TO_REPORT(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS r FROM orders", "SELECT o_orderkey, ROUND(o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS r FROM orders")
q("win_stats", "SELECT o_orderkey, ROUND(STDDEV(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS sd, ROUND(MEDIAN(o_totalprice) OVER (PARTITION BY o_custkey), 4) AS md FROM orders")
q("win_order_nulls", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY NULLIF(o_orderstatus, 'F') DESC, o_orderkey) AS rn FROM orders", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY NULLIF(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey) AS INTEGER) AS rn FROM orders")
q("win_rows_frame", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM orders")
q("win_range_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS c FROM orders")
# order and limits
q("sort_basic", "SELECT c_custkey, c_name FROM customer ORDER BY c_nationkey, c_acctbal DESC")
q("sort_nulls", "SELECT o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey")
q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 10 ROWS FETCH NEXT 5 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10")
q("limit_fetch", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey FETCH FIRST 7 ROWS ONLY", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
q("topk", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) WHERE ROWNUM <= 10", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
q("limit_with_ties", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority FETCH FIRST 3 ROWS WITH TIES", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY RANK() OVER (ORDER BY o_orderpriority) <= 3")
q("limit_percent", "SELECT c_custkey FROM customer ORDER BY c_custkey FETCH FIRST 10 PERCENT ROWS ONLY", "SELECT c_custkey FROM customer QUALIFY ROW_NUMBER() OVER (ORDER BY c_custkey) <= ceil(COUNT(*) OVER () * 10 / 100.0)")
q("limit_rownum", "SELECT n FROM (SELECT COUNT(*) AS n FROM (SELECT c_custkey FROM customer WHERE ROWNUM < 8))", "SELECT CAST(7 AS BIGINT) AS n")
# sets
q("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
q("set_minus", "SELECT n_nationkey AS k FROM nation MINUS SELECT s_nationkey FROM supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
q("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
q("set_chain", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION SELECT n_nationkey FROM nation WHERE n_nationkey < 6 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 1", "(SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3 UNION SELECT n_nationkey FROM nation WHERE n_nationkey < 6) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey > 1")
q("set_in_from", "SELECT COUNT(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier MINUS SELECT 3 FROM dual)", "SELECT COUNT(*) AS n FROM ((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT 3)")
# common tables and hierarchies
q("cte_basic", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey")
q("cte_multi", "WITH a AS (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey), b AS (SELECT r_name, a.n FROM region r JOIN a ON a.n_regionkey = r.r_regionkey) SELECT r_name, n FROM b")
q("cte_columns", "WITH t(k, total) AS (SELECT o_orderstatus, COUNT(*) FROM orders GROUP BY o_orderstatus) SELECT k, total FROM t")
q("cte_recursive", "WITH t(n, f) AS (SELECT n_nationkey, 1 FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n + 3, f * 2 FROM t WHERE n < 40) SELECT n, f FROM t", "WITH RECURSIVE t(n, f) AS (SELECT n_nationkey, 1 FROM nation WHERE n_regionkey < 3 UNION ALL SELECT n + 3, f * 2 FROM t WHERE n < 40) SELECT n, f FROM t")
TREE = "SELECT n_nationkey AS id, n_name AS nm, CASE WHEN n_nationkey > 4 THEN n_nationkey - 5 END AS boss FROM nation"
q("cte_search_depth", f"WITH e AS ({TREE}), t(id, nm, lvl) AS (SELECT id, nm, 1 FROM e WHERE boss IS NULL UNION ALL SELECT e.id, e.nm, t.lvl + 1 FROM t JOIN e ON e.boss = t.id) SEARCH DEPTH FIRST BY id SET ord SELECT id, lvl, ord FROM t", f"WITH RECURSIVE e AS ({TREE}), t AS (SELECT id, nm, 1 AS lvl, [id] AS path FROM e WHERE boss IS NULL UNION ALL SELECT e.id, e.nm, t.lvl + 1, list_append(t.path, e.id) FROM t JOIN e ON e.boss = t.id) SELECT id, lvl, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS ord FROM t")
q("cte_with_function", "WITH FUNCTION twice(x NUMBER) RETURN BINARY_DOUBLE IS BEGIN RETURN x * 2; END; SELECT n_nationkey, twice(n_nationkey) AS d FROM nation", "SELECT n_nationkey, CAST(n_nationkey * 2 AS DOUBLE) AS d FROM nation")
q("hier_connect_by", f"SELECT e.id, LEVEL AS lvl, CONNECT_BY_ROOT e.nm AS root, SYS_CONNECT_BY_PATH(e.nm, '/') AS path, CONNECT_BY_ISLEAF AS leaf FROM ({TREE}) e START WITH e.boss IS NULL CONNECT BY NOCYCLE PRIOR e.id = e.boss ORDER SIBLINGS BY e.nm", f"WITH RECURSIVE e AS ({TREE}), h AS (SELECT id, 1 AS lvl, nm AS root, '/' || nm AS path FROM e WHERE boss IS NULL UNION ALL SELECT e.id, h.lvl + 1, h.root, h.path || '/' || e.nm FROM e JOIN h ON e.boss = h.id) SELECT id, lvl, root, path, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.boss = h.id) THEN 0 ELSE 1 END AS leaf FROM h")
q("pivot_basic", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (COUNT(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS f, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS o, COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_orderpriority")
q("unpivot_basic", "SELECT l_orderkey, l_linenumber, what, v FROM (SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem) UNPIVOT (v FOR what IN (l_tax AS 'tax', l_discount AS 'disc'))", "SELECT l_orderkey, l_linenumber, 'tax' AS what, l_tax AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'disc', l_discount FROM lineitem")
