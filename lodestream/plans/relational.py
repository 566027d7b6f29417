"""Relational queries over the star schema: one text where Spark and the checking engine agree on it, else two."""

from __future__ import annotations

#: name -> text for both engines, or (Spark's, the checking engine's).
RELATIONAL: dict[str, str | tuple[str, str]] = {
    "s01_scan_range": "SELECT event_id, user_id, event_type FROM events WHERE event_id >= 100 AND event_id < 400",
    "s02_point_lookup": "SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events WHERE event_id = 77",
    "s03_committed_bound": "SELECT count(*) AS n FROM events WHERE event_id < 500",
    "s05_first_lsn_at": "SELECT min(event_id) AS lsn FROM events WHERE ts >= (SELECT ts FROM events WHERE event_id = 321)",
    "s06_head": "SELECT coalesce(max(event_id) + 1, 0) AS head FROM events",
    "p03_compare_ops": "SELECT event_id FROM events WHERE value >= 50 AND value < 120 AND event_type <> 'error' AND user_id != 3",
    "p04_and_or": "SELECT event_id FROM events WHERE event_type = 'purchase' OR event_type = 'click' AND value > 100",
    "p15_vectorized_filter": "SELECT event_id, user_id FROM events WHERE user_id > 40",
    "p16_fused_filters": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 30 AND l_discount > 0.03 AND l_returnflag = 'R'",
    "p17_column_scan": "SELECT l_orderkey, l_partkey FROM lineitem",
    "p18_arith_expr": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, (l_quantity > 25 AND NOT l_discount > 0.05) AS flag FROM lineitem",
    "p19_selection_algebra": "SELECT event_id FROM events WHERE (user_id < 20 OR event_type = 'view') AND NOT (value > 80)",
    "p22_validity_counts": "SELECT sum(CASE WHEN n IS NULL THEN 1 ELSE 0 END) AS null_count, count(n) AS valid_count FROM (SELECT nullif(l_linenumber, 1) AS n FROM lineitem) t",
    "d01_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "d02_like_between_in": "SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%STEEL%' OR p_size BETWEEN 5 AND 9 OR p_brand IN ('Brand#11', 'Brand#23')",
    "d02_is_distinct": "SELECT count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'",
    "f_conditional": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'ok' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, round(greatest(c_acctbal, 100.0), 2) AS hi, round(least(c_acctbal, 100.0), 2) AS lo FROM customer",
    "j_inner": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "j01_string_key_join": "SELECT count(*) AS n FROM orders JOIN customer ON CAST(o_custkey AS VARCHAR(20)) = CAST(c_custkey AS VARCHAR(20))",
    "j_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "j_right": "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) o RIGHT JOIN customer ON o_custkey = c_custkey",
    "j_full": "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) c ON s_suppkey = c_custkey",
    "j_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "j_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey"),
    "j_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "j_self": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "j_theta_range": "SELECT p_partkey, s_suppkey FROM (SELECT * FROM part WHERE p_size = 7) p JOIN (SELECT * FROM supplier WHERE s_suppkey <= 20) s ON p_retailprice < s_acctbal AND p_retailprice + 500 > s_acctbal",
    "j_interval": "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id > a.event_id AND b.event_id <= a.event_id + 50",
    "j_multiway": "SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "j_using_natural": "SELECT count(*) AS n FROM (SELECT o_orderkey AS k FROM orders) a JOIN (SELECT l_orderkey AS k FROM lineitem) b USING (k)",
    "d08_lateral": "SELECT n_name, x.n AS customers FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) x",
    "a01_group_count_sum": "SELECT CAST(l_returnflag AS VARCHAR(9)) AS key0, CAST(l_linenumber AS VARCHAR(9)) AS key1, count(*) AS count, CAST(sum(l_orderkey) AS BIGINT) AS sum0 FROM lineitem GROUP BY l_returnflag, l_linenumber",
    "a02_sql_aggregate": ("SELECT event_type, count(*) AS n, sum(octet_length(props)) AS bytes FROM events GROUP BY event_type", "SELECT event_type, count(*) AS n, CAST(sum(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY event_type"),
    "a_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus",
    "a_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "a_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "a_rollup": "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "a_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "a_filter_clause": "SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 30) AS big, round(avg(l_discount) FILTER (WHERE l_tax < 0.05), 6) AS d FROM lineitem GROUP BY l_linestatus",
    "a_percentile": ("SELECT l_returnflag, round(percentile(l_quantity, 0.25), 4) AS q1, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 4) AS q1, round(median(l_quantity), 4) AS med FROM lineitem GROUP BY l_returnflag"),
    "a31_stddev": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_discount), 8) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_tax), 6) AS cv FROM lineitem GROUP BY l_returnflag",
    "d14_regression": "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS icept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem",
    "d13_bool_bit": "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS all_pos, bool_or(o_totalprice > 400000) AS any_big, bit_and(o_orderkey) AS ba, bit_or(o_orderkey) AS bo, bit_xor(o_orderkey) AS bx FROM orders GROUP BY o_orderstatus",
    "w_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
    "w_rank": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size), 6) AS cd FROM part",
    "w_lag_lead": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, lead(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS next2 FROM events",
    "w_running_sum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events",
    "w_moving_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m FROM events",
    "w_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM events",
    "w_first_last": "SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "w_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS q FROM customer",
    "d19_qualify": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) t WHERE rn = 1",
    "t_order_limit": "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "t_offset": "SELECT c_custkey FROM customer ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 10 OFFSET 15",
    "t04_topk": "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50",
    "t_topk_per_group": "SELECT * FROM (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) t WHERE rn <= 5",
    "x_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "x_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "x_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "x_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "x_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "x_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "q_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 350000)",
    "q_not_exists": "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)",
    "q_in_subquery": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9500)",
    "q_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM orders)",
    "q_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT 1.05 * avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "q_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON o_custkey = c_custkey WHERE t > 1500000 GROUP BY c_mktsegment",
    "q_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r",
    "d22_values_unnest": ("SELECT k, explode(sequence(1, k)) AS i FROM (VALUES (1), (3), (2)) AS t(k)", "SELECT k, unnest(range(1, k + 1))::INTEGER AS i FROM (VALUES (1), (3), (2)) AS t(k)"),
    "f_string": ("SELECT c_custkey, upper(c_name) AS u, substr(c_name, 3, 5) AS s, lpad(c_mktsegment, 12, '*') AS l, reverse(c_name) AS r, concat_ws('-', c_mktsegment, c_name) AS c, instr(c_name, '0') AS p, replace(c_name, '0', 'o') AS x, split_part(c_name, '#', 2) AS sp, levenshtein(c_name, c_mktsegment) AS lev, octet_length(c_name) AS o, ascii(c_name) AS a, initcap(lower(c_mktsegment)) AS i, startswith(c_name, 'Cust') AS sw FROM customer", "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 3, 5) AS s, lpad(c_mktsegment, 12, '*') AS l, reverse(c_name) AS r, concat_ws('-', c_mktsegment, c_name) AS c, instr(c_name, '0')::INTEGER AS p, replace(c_name, '0', 'o') AS x, split_part(c_name, '#', 2) AS sp, levenshtein(c_name, c_mktsegment)::INTEGER AS lev, strlen(c_name)::INTEGER AS o, ascii(c_name) AS a, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i, starts_with(c_name, 'Cust') AS sw FROM customer"),
    "f_regex": ("SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '') AS r, regexp_count(p_name, '[aeiou]') AS n, regexp_like(p_name, '^[a-m]') AS m, regexp_extract(p_type, '^([A-Z]+)', 1) AS e FROM part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') AS r, len(regexp_extract_all(p_name, '[aeiou]'))::INTEGER AS n, regexp_matches(p_name, '^[a-m]') AS m, regexp_extract(p_type, '^([A-Z]+)', 1) AS e FROM part"),
    "f_date": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd') AS mo, date_format(o_orderdate + INTERVAL 10 DAY, 'yyyy-MM-dd') AS plus, datediff(DATE'1999-01-01', CAST(o_orderdate AS DATE)) AS days, quarter(o_orderdate) AS q FROM orders", "SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS mo, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS plus, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01')::INTEGER AS days, quarter(o_orderdate)::INTEGER AS q FROM orders"),
    "f_math": "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS s, round(ln(l_quantity), 6) AS l, round(power(l_discount + 1, 3), 6) AS p, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_tax * 10) AS BIGINT) AS c, round(abs(l_discount - 0.05), 6) AS a, round(sin(l_quantity), 6) AS sn, round(atan2(l_tax, l_discount + 1), 6) AS at, round(cbrt(l_quantity), 6) AS cb, round(log10(l_quantity), 6) AS lg, round(exp(l_tax), 6) AS ex, round(degrees(l_tax), 6) AS dg FROM lineitem",
    "f_array": ("SELECT vec_id, size(embedding) AS n, round(CAST(array_max(embedding) AS DOUBLE), 5) AS mx, size(array_distinct(slice(embedding, 1, 8))) AS ds, array_contains(array(label, 3), 3) AS c, element_at(array(label, 7, 9), 2) AS e, array_join(transform(sequence(1, 3), x -> x * label), ',') AS j, array_position(array(5, label), label) AS p, size(flatten(array(array(1, 2), array(label)))) AS fl FROM embeddings", "SELECT vec_id, len(embedding)::INTEGER AS n, round(CAST(list_max(embedding) AS DOUBLE), 5) AS mx, len(list_distinct(embedding[1:8]))::INTEGER AS ds, list_contains([label, 3], 3) AS c, [label, 7, 9][2]::INTEGER AS e, array_to_string(list_transform([1, 2, 3], lambda x: x * label), ',') AS j, list_position([5, label], label)::BIGINT AS p, len(flatten([[1, 2], [label]]))::INTEGER AS fl FROM embeddings"),
    "f_map": ("SELECT o_orderkey, element_at(map('s', o_orderstatus, 'p', o_orderpriority), 's') AS s, array_join(map_keys(map('a', 1, 'b', 2)), ',') AS k FROM orders", "SELECT o_orderkey, map {'s': o_orderstatus, 'p': o_orderpriority}['s'] AS s, array_to_string(map_keys(map {'a': 1, 'b': 2}), ',') AS k FROM orders"),
    "f_struct": ("SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey).b AS b FROM nation", "SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey).b AS b FROM nation"),
    "f_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "f_hash_encoding": ("SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, lower(hex(n_name)) AS h, base64(CAST(n_name AS BINARY)) AS b FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, lower(hex(n_name)) AS h, base64(encode(n_name)) AS b FROM nation"),
    "f_casts": ("SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) <= 1 AS near, try_cast(o_orderpriority AS INT) AS bad, CAST(o_custkey AS STRING) AS s FROM orders", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) - CAST(floor(o_totalprice) AS BIGINT) <= 1 AS near, try_cast(o_orderpriority AS INTEGER) AS bad, CAST(o_custkey AS VARCHAR) AS s FROM orders"),
    "q1_pricing": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
    "q6_forecast": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24",
    "st_tumbling": ("SELECT date_format(window.start, 'yyyy-MM-dd') AS day, event_type, count(*) AS n FROM (SELECT window(CAST(ts AS TIMESTAMP), '1 day') AS window, event_type FROM events) t GROUP BY window.start, event_type", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type"),
    "st_sliding": ("SELECT date_format(window.start, 'yyyy-MM-dd HH') AS start, count(*) AS n FROM (SELECT window(CAST(ts AS TIMESTAMP), '1 day', '12 hours') AS window FROM events) t GROUP BY window.start", "SELECT strftime(s, '%Y-%m-%d %H') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '12 hours' AS s FROM events, (VALUES (0), (1)) AS t(k)) GROUP BY s"),
    "st_session": ("SELECT user_id, count(*) AS n, count(DISTINCT session_window) AS m FROM (SELECT user_id, session_window(CAST(ts AS TIMESTAMP), '6 hours') AS session_window FROM events GROUP BY user_id, session_window(CAST(ts AS TIMESTAMP), '6 hours')) t GROUP BY user_id", "SELECT user_id, count(*) AS n, count(*) AS m FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE p IS NULL OR ts >= p + INTERVAL '6 hours' GROUP BY user_id"),
    "st_dedup": "SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY user_id, event_type",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")
