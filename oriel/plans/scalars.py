"""Scalar functions and collections."""

from __future__ import annotations

from .base import Registry

R = Registry()
q = R.add

q("fn_sysdate", "SELECT o_orderkey, CASE WHEN SYSDATE > o_orderdate THEN 1 ELSE 0 END AS a, CASE WHEN SYSTIMESTAMP > o_orderdate THEN 1 ELSE 0 END AS b, CASE WHEN CURRENT_DATE >= o_orderdate THEN 1 ELSE 0 END AS c, CASE WHEN CURRENT_TIMESTAMP > o_orderdate THEN 1 ELSE 0 END AS d FROM orders", "SELECT o_orderkey, 1 AS a, 1 AS b, 1 AS c, 1 AS d FROM orders WHERE o_orderdate < now()::TIMESTAMP")
q("fn_user", "SELECT c_custkey, CASE WHEN USER || c_name = CURRENT_USER || c_name THEN 1 ELSE 0 END AS u, CASE WHEN LENGTH(SESSION_USER || c_name) > LENGTH(c_name) THEN 1 ELSE 0 END AS s FROM customer", "SELECT c_custkey, 1 AS u, 1 AS s FROM customer")
q("fn_string_basic", "SELECT LENGTH(c_name) AS n, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, REVERSE(c_name) AS r, INITCAP(c_mktsegment) AS i FROM customer", "SELECT CAST(LENGTH(c_name) AS INTEGER) AS n, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, REVERSE(c_name) AS r, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i FROM customer")
q("fn_pad_replace", "SELECT LPAD(n_nationkey, 4, '0') AS p, RPAD(n_name, 12, '.') AS r, REPLACE(n_name, 'NATION_') AS x FROM nation", "SELECT LPAD(n_nationkey::VARCHAR, 4, '0') AS p, RPAD(n_name, 12, '.') AS r, REPLACE(n_name, 'NATION_', '') AS x FROM nation")
q("fn_trim", "SELECT TRIM('  ' || c_name || ' ') AS a, LTRIM(c_name, 'Cu') AS b, RTRIM(c_name, '0123') AS c, TRIM(LEADING '0' FROM LPAD(c_custkey, 9, '0')) AS d, TRIM(BOTH 'z' FROM 'z' || c_name || 'z') AS e FROM customer", "SELECT c_name AS a, ltrim(c_name, 'Cu') AS b, rtrim(c_name, '0123') AS c, ltrim(lpad(c_custkey::VARCHAR, 9, '0'), '0') AS d, trim('z' || c_name || 'z', 'z') AS e FROM customer")
q("fn_substr", "SELECT SUBSTR(c_name, 3) AS a, SUBSTR(c_name, 0, 4) AS b, SUBSTR(c_name, -3, 2) AS c FROM customer", "SELECT substr(c_name, 3) AS a, substr(c_name, 1, 4) AS b, substr(c_name, -3, 2) AS c FROM customer")
q("fn_instr", "SELECT n_name, INSTR(n_name, '_') AS a, INSTR(n_name, '1') AS b FROM nation", "SELECT n_name, CAST(instr(n_name, '_') AS INTEGER) AS a, CAST(instr(n_name, '1') AS INTEGER) AS b FROM nation")
q("fn_instr_pos_occ", "SELECT c_custkey, INSTR(c_name, '0', 1, 2) AS a, INSTR(c_name, '1', 4) AS b, INSTR(c_name, '?', 1, 1) AS c, INSTR(c_name, '0', -1) AS d FROM customer", """SELECT c_custkey, CAST(CASE WHEN instr(c_name, '0') = 0 OR instr(substr(c_name, instr(c_name, '0') + 1), '0') = 0 THEN 0 ELSE instr(c_name, '0') + instr(substr(c_name, instr(c_name, '0') + 1), '0') END AS INTEGER) AS a,
  CAST(CASE WHEN instr(substr(c_name, 4), '1') = 0 THEN 0 ELSE 3 + instr(substr(c_name, 4), '1') END AS INTEGER) AS b, 0 AS c, CAST(CASE WHEN instr(c_name, '0') = 0 THEN 0 ELSE length(c_name) - instr(reverse(c_name), '0') + 1 END AS INTEGER) AS d FROM customer""")
q("fn_math", "SELECT ABS(c_acctbal) AS a, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, POWER(2, 10) AS p, SQRT(ABS(c_acctbal)) AS s, SIGN(c_acctbal) AS g FROM customer", "SELECT ABS(c_acctbal) AS a, CAST(CEIL(c_acctbal) AS BIGINT) AS c, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, 1024.0::DOUBLE AS p, SQRT(ABS(c_acctbal)) AS s, CAST(SIGN(c_acctbal) AS DOUBLE) AS g FROM customer")
q("fn_round_trunc", "SELECT ROUND(c_acctbal, 1) AS r, TRUNC(c_acctbal, 1) AS t, TRUNC(c_acctbal) AS z FROM customer", "SELECT ROUND(c_acctbal, 1) AS r, trunc(c_acctbal * 10) / 10 AS t, trunc(c_acctbal) AS z FROM customer")
q("fn_trunc_date", "SELECT o_orderkey, TRUNC(o_orderdate, 'MM') AS m, TRUNC(o_orderdate, 'YYYY') AS y, TRUNC(o_orderdate) AS d, TRUNC(o_orderdate, 'Q') AS k FROM orders", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, date_trunc('year', o_orderdate)::TIMESTAMP AS y, date_trunc('day', o_orderdate)::TIMESTAMP AS d, date_trunc('quarter', o_orderdate)::TIMESTAMP AS k FROM orders")
q("fn_mod", "SELECT MOD(-7, 3) AS a, MOD(n_nationkey, 5) AS b FROM nation", "SELECT -7 % 3 AS a, n_nationkey % 5 AS b FROM nation")
q("fn_to_char", "SELECT o_orderkey, TO_CHAR(o_orderdate, 'YYYY-MM-DD HH24:MI:SS') AS d, TO_CHAR(o_orderdate, 'DD\"th of\" MM') AS e, TO_CHAR(o_orderkey) AS k, TO_CHAR(o_totalprice, 'FM999999990.00') AS p FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS d, strftime(o_orderdate, '%dth of %m') AS e, o_orderkey::VARCHAR AS k, printf('%.2f', o_totalprice) AS p FROM orders")
q("fn_to_number", "SELECT o_orderkey, CAST(TO_NUMBER(o_custkey || '.50') AS BINARY_DOUBLE) AS a, CAST(TO_NUMBER('1,' || LPAD(MOD(o_orderkey, 1000), 3, '0'), '9,999') AS BINARY_DOUBLE) AS b, CAST(TO_NUMBER(o_orderstatus DEFAULT -1 ON CONVERSION ERROR) AS BINARY_DOUBLE) AS c FROM orders", "SELECT o_orderkey, o_custkey + 0.5::DOUBLE AS a, (1000 + o_orderkey % 1000)::DOUBLE AS b, -1::DOUBLE AS c FROM orders")
q("fn_to_date", "SELECT o_orderkey, TO_DATE(TO_CHAR(o_orderdate, 'YYYY-MM-DD'), 'YYYY-MM-DD') AS a, TO_DATE(TO_CHAR(o_orderdate, 'DD/MM/YYYY') || ' 23:59', 'DD/MM/YYYY HH24:MI') AS b FROM orders", "SELECT o_orderkey, o_orderdate::DATE::TIMESTAMP AS a, o_orderdate::DATE + INTERVAL 23 HOUR + INTERVAL 59 MINUTE AS b FROM orders")
q("fn_nvl", "SELECT o_orderkey, NVL(NULLIF(o_orderstatus, 'F'), 'none') AS s FROM orders", "SELECT o_orderkey, COALESCE(NULLIF(o_orderstatus, 'F'), 'none') AS s FROM orders")
q("fn_nvl2", "SELECT o_orderkey, NVL2(NULLIF(o_orderstatus, 'F'), 'open', 'done') AS s FROM orders", "SELECT o_orderkey, CASE WHEN NULLIF(o_orderstatus, 'F') IS NOT NULL THEN 'open' ELSE 'done' END AS s FROM orders")
q("fn_decode", "SELECT o_orderkey, DECODE(NULLIF(o_orderstatus, 'P'), 'F', 'fin', NULL, 'nul', 'oth') AS s FROM orders", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'fin' WHEN NULLIF(o_orderstatus, 'P') IS NULL THEN 'nul' ELSE 'oth' END AS s FROM orders")
q("fn_greatest_least", "SELECT GREATEST(c_acctbal, 0, c_custkey) AS g, LEAST(c_acctbal, 100) AS l FROM customer", "SELECT GREATEST(c_acctbal, 0, c_custkey)::DOUBLE AS g, LEAST(c_acctbal, 100)::DOUBLE AS l FROM customer")
q("fn_add_months", "SELECT o_orderkey, CAST(ADD_MONTHS(o_orderdate, 1) AS DATE) AS a, CAST(ADD_MONTHS(DATE '2024-02-29', 1) AS DATE) AS b FROM orders", "SELECT o_orderkey, CASE WHEN o_orderdate::DATE = last_day(o_orderdate) THEN last_day(o_orderdate + INTERVAL 1 MONTH) ELSE (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE END::TIMESTAMP AS a, TIMESTAMP '2024-03-31' AS b FROM orders")
q("fn_months_between", "SELECT o_orderkey, ROUND(MONTHS_BETWEEN(TRUNC(o_orderdate), DATE '1995-02-28'), 6) AS a FROM orders", """SELECT o_orderkey, ROUND((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 2 + CASE WHEN o_orderdate::DATE = last_day(o_orderdate) OR day(o_orderdate) = 28 THEN 0 ELSE (day(o_orderdate) - 28) / 31.0 END, 6)::DOUBLE AS a FROM orders""")
q("fn_coalesce", "SELECT COALESCE(NULLIF(c_mktsegment, 'BUILDING'), NULLIF(c_name, 'x'), 'z') AS s FROM customer")
q("fn_cast", "SELECT CAST(o_totalprice AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR2(20)) AS s, CAST('2024-01-05' AS DATE) AS d FROM orders", "SELECT CAST(trunc(o_totalprice) AS INTEGER) AS i, CAST(o_orderkey AS VARCHAR) AS s, TIMESTAMP '2024-01-05' AS d FROM orders")
q("fn_cast_default", "SELECT o_orderkey, CAST(o_orderstatus AS INTEGER DEFAULT 7 ON CONVERSION ERROR) AS a, CAST(TO_CHAR(o_custkey) AS INTEGER DEFAULT 7 ON CONVERSION ERROR) AS b FROM orders", "SELECT o_orderkey, 7 AS a, CAST(o_custkey AS INTEGER) AS b FROM orders")
q("fn_extract", "SELECT o_orderkey, EXTRACT(YEAR FROM o_orderdate) AS y, EXTRACT(MONTH FROM o_orderdate) AS m, EXTRACT(DAY FROM o_orderdate) AS d FROM orders", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INTEGER) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INTEGER) AS d FROM orders")
q("fn_translate", "SELECT TRANSLATE(n_name, 'NA_', 'na-') AS t FROM nation")
q("fn_chr", "SELECT n_nationkey, CHR(65 + n_nationkey) AS a, CHR(97 + n_nationkey USING NCHAR_CS) AS b, ASCII(SUBSTR(n_name, n_regionkey + 1)) AS c FROM nation", "SELECT n_nationkey, chr(CAST(65 + n_nationkey AS INTEGER)) AS a, chr(CAST(97 + n_nationkey AS INTEGER)) AS b, ascii(substr(n_name, n_regionkey + 1)) AS c FROM nation")
q("fn_to_timestamp", "SELECT o_orderkey, TO_TIMESTAMP(TO_CHAR(o_orderdate, 'YYYY-MM-DD') || ' 07:08:09', 'YYYY-MM-DD HH24:MI:SS') AS a, TO_BINARY_DOUBLE(o_custkey || '.5') AS b FROM orders", "SELECT o_orderkey, o_orderdate::DATE + INTERVAL 7 HOUR + INTERVAL 8 MINUTE + INTERVAL 9 SECOND AS a, o_custkey + 0.5::DOUBLE AS b FROM orders")
q("fn_to_interval", "SELECT o_orderkey, o_orderdate + TO_DSINTERVAL(MOD(o_orderkey, 9) || ' 02:00:00') AS a, CAST(TO_DSINTERVAL(MOD(o_orderkey, 9) || ' 00:00:00') AS VARCHAR2(60)) AS b FROM orders", "SELECT o_orderkey, o_orderdate + to_days(CAST(o_orderkey % 9 AS INTEGER)) + INTERVAL 2 HOUR AS a, 'INTERVAL ' || chr(39) || o_orderkey % 9 || ' 00:00:00' || chr(39) || ' DAY TO SECOND' AS b FROM orders")
q("fn_validate_conversion", "SELECT o_orderkey, VALIDATE_CONVERSION(o_custkey || o_orderstatus AS NUMBER) AS a, VALIDATE_CONVERSION(TO_CHAR(o_custkey) AS NUMBER) AS b FROM orders", "SELECT o_orderkey, 0 AS a, 1 AS b FROM orders")
q("fn_regexp", "SELECT n_name, REGEXP_SUBSTR(n_name, '[0-9]+') AS d, REGEXP_REPLACE(n_name, '[0-9]', '#') AS r, REGEXP_COUNT(n_name, 'N') AS c FROM nation WHERE REGEXP_LIKE(n_name, '1[0-9]$')", "SELECT n_name, regexp_extract(n_name, '[0-9]+') AS d, regexp_replace(n_name, '[0-9]', '#', 'g') AS r, CAST(len(regexp_extract_all(n_name, 'N')) AS INTEGER) AS c FROM nation WHERE regexp_matches(n_name, '1[0-9]$')")
q("fn_json_value", "SELECT event_id, JSON_VALUE(props, '$.k' RETURNING NUMBER(9)) AS k, JSON_VALUE(props, '$.none' DEFAULT '?' ON EMPTY) AS d FROM events", "SELECT event_id, CAST(props->>'$.k' AS DECIMAL(9,0)) AS k, COALESCE(props->>'$.none', '?') AS d FROM events")
q("fn_json_object", "SELECT JSON_OBJECT(KEY 'key' VALUE n_nationkey, 'name' VALUE n_name) AS j FROM nation", "SELECT '{\"key\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS j FROM nation")
q("fn_json_array", "SELECT JSON_ARRAY(n_nationkey, n_name, NULL NULL ON NULL) AS j FROM nation", "SELECT '[' || n_nationkey || ',\"' || n_name || '\",null]' AS j FROM nation")
q("fn_json_query", "SELECT event_id, JSON_QUERY('{\"a\":{\"b\":[' || event_id || ',2]}}', '$.a.b') AS j, JSON_EXISTS(props, '$.k') AS e, JSON_EXISTS(props, '$.none') AS f FROM events", "SELECT event_id, '[' || event_id || ',2]' AS j, props->>'$.k' IS NOT NULL AS e, FALSE AS f FROM events")
q("arr_index", "SELECT e.vec_id, e.embedding(2) AS v FROM embeddings e", "SELECT vec_id, embedding[2] AS v FROM embeddings")
q("arr_count", "SELECT e.vec_id, e.embedding.COUNT AS n FROM embeddings e", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
q("arr_first_last", "SELECT e.vec_id, e.embedding.FIRST AS f, e.embedding.LAST AS l FROM embeddings e", "SELECT vec_id, 1 AS f, CAST(len(embedding) AS INTEGER) AS l FROM embeddings")
q("arr_exists", "SELECT e.vec_id, e.embedding.EXISTS(64) AS a, e.embedding.EXISTS(65) AS b FROM embeddings e", "SELECT vec_id, len(embedding) >= 64 AS a, len(embedding) >= 65 AS b FROM embeddings")
q("arr_next_prior", "SELECT e.vec_id, e.embedding.NEXT(3) AS n, e.embedding.PRIOR(1) AS p, e.embedding.PRIOR(5) AS r FROM embeddings e", "SELECT vec_id, 4 AS n, CAST(NULL AS INTEGER) AS p, 4 AS r FROM embeddings")
q("arr_constructor", "SELECT n_nationkey, CARDINALITY(t_numbers(n_nationkey, 2, 3)) AS n FROM nation", "SELECT n_nationkey, 3 AS n FROM nation")
q("multiset_ops", "SELECT n_nationkey, t_numbers(1, 2, 2, 3) MULTISET UNION t_numbers(n_nationkey) AS u, t_numbers(1, 2, 2, 3) MULTISET INTERSECT DISTINCT t_numbers(2, 3, n_nationkey + 100) AS i, t_numbers(1, 2, 2, 3) MULTISET EXCEPT t_numbers(2, n_nationkey + 100) AS x FROM nation", "SELECT n_nationkey, [1, 2, 2, 3, n_nationkey]::BIGINT[] AS u, [2, 3]::BIGINT[] AS i, [1, 2, 3]::BIGINT[] AS x FROM nation")
q("multiset_member", "SELECT n_nationkey MEMBER OF t_numbers(1, 2, 3) AS m, t_numbers(1, 2) SUBMULTISET OF t_numbers(1, 2, 3) AS s, t_numbers(1, 1) IS A SET AS a FROM nation", "SELECT n_nationkey IN (1, 2, 3) AS m, TRUE AS s, FALSE AS a FROM nation")
q("bulk_collect", "SELECT n_regionkey, COLLECT(n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, list(n_name ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
