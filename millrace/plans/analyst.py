"""Analyst queries as SQL texts: ``SPARK`` is what runs through ``run_sql``,
``CHECK`` the text for the check where its dialect differs.

Window queries partition by user and day and set results by key, so that no
single task receives all rows of a busy user.
"""

from __future__ import annotations

SPARK: dict[str, str] = {}
CHECK: dict[str, str] = {}


def both(name: str, sql: str, check: str | None = None) -> None:
    SPARK[name], CHECK[name] = sql, check or sql


both("q_select_limit", "SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 10")

both("q_filter_cast", """
WITH lake AS (SELECT CAST(event_id AS {s}) AS id, event_type, CAST(value AS {s}) AS v, ts, props, CAST(user_id AS {s}) AS u FROM events)
SELECT id, event_type, CAST(v AS DOUBLE) AS value, CAST(u AS BIGINT) AS user_id FROM lake
WHERE CAST(v AS DOUBLE) > 12.5 AND event_type IN ('click', 'purchase', 'view') AND props LIKE '%"k"%'
  AND ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-25 12:00:00' AND u IS NOT NULL""")

both("q_join_inner", """
SELECT r_name, n_name, c_mktsegment, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, c_mktsegment""")

both("q_join_left", """
SELECT c_custkey, c_name, coalesce(n_orders, 0) AS n_orders, coalesce(spent, 0) AS spent
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent
  FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey""")

both("q_join_full", """
SELECT coalesce(s.k, c.k) AS nation, s.n AS suppliers, c.n AS customers
FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s
FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c ON s.k = c.k""")

both("q_join_semi", """
SELECT c_custkey, c_mktsegment FROM customer c
WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_totalprice > 200000)""")

# the NOT IN side is a list of distinct nations
both("q_join_anti", """
SELECT c_custkey, c_nationkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
  AND c_nationkey NOT IN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 9500)""")

both("q_join_theta", """
SELECT band, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders
JOIN (VALUES ('a', 0.0, 50000.0), ('b', 50000.0, 150000.0), ('c', 150000.0, 300000.0), ('d', 300000.0, 1e12)) AS b(band, lo, hi)
  ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band""")

both("q_agg_group", """
SELECT CAST(CAST(ts AS DATE) AS {s}) AS day, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
  round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(stddev_samp(value), 6) AS spread
FROM events GROUP BY CAST(ts AS DATE), event_type""")

both("q_agg_distinct", """
SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT props) AS props
FROM events GROUP BY event_type""")

both("q_agg_filter", """
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE value > 20) AS large,
  CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS spent
FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'error') >= 10""")

# estimates next to the exact figures: distinct users within five standard errors,
# percentiles by the rank that the estimate has, at the accuracy of one in 10,000
SPARK["q_agg_approx"] = """
WITH e AS (
  SELECT event_type, approx_count_distinct(user_id, 0.01) AS users, percentile_approx(value, 0.5, 10000) AS median,
    percentile_approx(value, 0.99, 10000) AS p99
  FROM events GROUP BY event_type)
SELECT event_type, abs(any_value(e.users) - count(DISTINCT user_id)) <= 0.05 * count(DISTINCT user_id) AS users,
  count_if(value < median) <= 0.5001 * count(value) AND count_if(value <= median) >= 0.4999 * count(value) AS median,
  count_if(value < p99) <= 0.9901 * count(value) AND count_if(value <= p99) >= 0.9899 * count(value) AS p99
FROM events JOIN e USING (event_type) GROUP BY event_type"""
CHECK["q_agg_approx"] = "SELECT event_type, true AS users, true AS median, true AS p99 FROM events GROUP BY event_type"

# distinct types per user: five values at most
both("q_agg_collect", """
SELECT user_id, listagg(DISTINCT event_type, ',') WITHIN GROUP (ORDER BY event_type) AS types,
  max_by(event_id, struct(value, event_id)) AS top_event, min_by(event_type, struct(ts, event_id)) AS first_type
FROM events GROUP BY user_id""", """
SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types,
  arg_max(event_id, (value, event_id)) AS top_event, arg_min(event_type, (ts, event_id)) AS first_type
FROM events GROUP BY user_id""")

_REVENUE = """
SELECT r_name, n_name, {gid} AS level, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY {how}"""
for _name, _how in (("q_rollup", "ROLLUP (r_name, n_name)"), ("q_cube", "CUBE (r_name, n_name)"),
                    ("q_grouping_sets", "GROUPING SETS ((r_name, n_name), (r_name), ())")):
    both(_name, _REVENUE.format(gid="CAST(grouping_id() AS BIGINT)", how=_how),
         _REVENUE.format(gid="CAST(grouping(r_name, n_name) AS BIGINT)", how=_how))

both("q_win_rank", """
SELECT event_id, row_number() OVER w AS rn, ntile(4) OVER w AS quarter, rank() OVER c AS rk, dense_rank() OVER c AS drk,
  round(percent_rank() OVER c, 9) AS prk
FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value, event_id),
  c AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_type)""")

both("q_win_analytic", """
SELECT event_id, lag(value, 1) OVER w AS before, lead(event_type, 1, 'none') OVER w AS after,
  first_value(event_id) OVER w AS opening,
  last_value(event_id) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS closing
FROM events WINDOW w AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id)""")

both("q_win_frame", """
SELECT event_id, CAST(sum(v) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running,
  CAST(sum(v) OVER (PARTITION BY user_id, day ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_hour,
  count(*) OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near
FROM (SELECT *, CAST(ts AS DATE) AS day, CAST(value AS DECIMAL(18,2)) AS v FROM events) e""")

both("q_topk", """
SELECT o_custkey, o_orderkey, rn FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) o
WHERE rn <= 3""")

_A = "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'"
_B = "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 3000"
for _name, _op in (("q_union", "UNION"), ("q_intersect", "INTERSECT"), ("q_except", "EXCEPT")):
    both(_name, f"""
SELECT 'distinct' AS kind, k, count(*) AS n FROM (({_A}) {_op} ({_B})) d GROUP BY k
UNION ALL SELECT 'all' AS kind, k, count(*) AS n FROM (({_A}) {_op} ALL ({_B})) a GROUP BY k""")

both("q_cte_subquery", """
WITH spent AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT c_custkey, total, (SELECT max(o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS last_order
FROM customer c JOIN spent s ON s.o_custkey = c.c_custkey
WHERE s.n > (SELECT CAST(count(*) AS DOUBLE) / count(DISTINCT o_custkey) FROM orders)
  AND c.c_acctbal > (SELECT avg(c2.c_acctbal) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey)""")

both("q_fn_string", """
SELECT p_partkey, upper(p_name) AS up, trim(concat('  ', p_type, ' ')) AS tr, substring(p_brand, 7, 2) AS num,
  split_part(p_name, ' ', 2) AS second, replace(p_name, 'e', '3') AS leet, length(p_name) AS len,
  regexp_replace(p_brand, '[0-9]+', '#') AS masked, lpad(CAST(p_size AS {s}), 4, '0') AS padded, reverse(p_brand) AS rev,
  concat_ws('|', p_brand, p_type) AS joined, position('#' IN p_brand) AS pos, starts_with(p_name, 'red') AS red
FROM part""".replace("starts_with", "{starts}"))

both("q_fn_date", """
SELECT event_id, CAST(date_trunc('hour', ts) AS {s}) AS h, extract(year FROM ts) AS y, extract(month FROM ts) AS mo,
  extract(day FROM ts) AS d, extract(hour FROM ts) AS hh, date_diff(DATE '2024-02-01', CAST(ts AS DATE)) AS left_days,
  CAST(CAST(ts AS DATE) + INTERVAL '7' DAY AS DATE) = CAST(ts AS DATE) AS same, date_format(ts, 'yyyyMMdd-HHmm') AS stamp,
  date_format(timestamp_millis(CAST(unix_micros(CAST(ts AS TIMESTAMP)) DIV 1000 AS BIGINT)), 'HH:mm:ss') AS clock
FROM events""", """
SELECT event_id, CAST(date_trunc('hour', ts) AS VARCHAR) AS h, extract(year FROM ts) AS y, extract(month FROM ts) AS mo,
  extract(day FROM ts) AS d, extract(hour FROM ts) AS hh, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01') AS left_days,
  false AS same, strftime(ts, '%Y%m%d-%H%M') AS stamp, strftime(ts, '%H:%M:%S') AS clock FROM events""")

both("q_fn_math", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / 7, 3) AS seventh, abs(l_discount - l_tax) > 0.03 AS apart,
  floor(l_extendedprice) AS fl, ceil(l_quantity / 3) AS ce, power(l_quantity, 2) AS sq, round(ln(l_extendedprice), 6) AS lg,
  l_orderkey % 7 AS md, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo, {div} AS ratio, sign(l_tax - l_discount) AS sg
FROM lineitem""")

both("q_fn_json", """
SELECT event_type, CAST(get_json_object(props, '$.k') AS INT) AS k, count(*) AS n, min(from_json(props, 'k INT').k) AS low,
  max(variant_get(parse_json(props), '$.k', 'int')) AS high FROM events GROUP BY 1, 2""", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, k AS low, k AS high
FROM events GROUP BY 1, 2""")

both("q_fn_array_map", """
SELECT label, count(*) AS n, count_if(x > 0) AS positive, CAST(max(x) AS DOUBLE) AS top, max(pos) AS last_pos,
  sum(IF(pos = 0, size(filter(embedding, e -> e > 0)), 0)) AS positive_again, max(array_max(transform(embedding, e -> CAST(abs(e) AS DOUBLE)))) AS top_abs,
  min(map_keys(map('label', label))[0]) AS key_name
FROM embeddings LATERAL VIEW posexplode(embedding) p AS pos, x GROUP BY label""", """
SELECT label, count(*) AS n, count(*) FILTER (WHERE x > 0) AS positive, CAST(max(x) AS DOUBLE) AS top, max(pos) AS last_pos,
  count(*) FILTER (WHERE x > 0) AS positive_again, CAST(max(abs(x)) AS DOUBLE) AS top_abs, 'label' AS key_name
FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) e GROUP BY label""")

both("q_fn_conditional", """
SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
  coalesce(nullif(o_orderstatus, 'F'), 'done') AS status, try_cast(split_part(o_orderpriority, '-', 1) AS INT) AS prio,
  try_cast(o_orderpriority AS INT) AS no_number, o_orderstatus IN ('F', 'P') AS settled
FROM orders""")

both("q_distinct_values", """
SELECT t.event_type, v.weight, u.users FROM (SELECT DISTINCT event_type FROM events) t
JOIN (VALUES ('click', 1), ('purchase', 5), ('view', 2), ('signup', 3)) AS v(event_type, weight) ON v.event_type = t.event_type
JOIN (SELECT event_type, count(*) AS users FROM (SELECT DISTINCT event_type, user_id FROM events) d GROUP BY event_type) u
  ON u.event_type = t.event_type""")

# sampling is the operator here: one key in ten, the same ones every time
both("q_sample", "SELECT event_id, user_id, event_type FROM events WHERE (event_id * 48271) % 2147483647 % 10 = 0")

_TYPES = ({"s": "STRING", "starts": "startswith", "div": "round(try_divide(l_extendedprice, l_discount), 6)"},
          {"s": "VARCHAR", "starts": "starts_with",
           "div": "CASE WHEN l_discount = 0 THEN NULL ELSE round(l_extendedprice / l_discount, 6) END"})


def _fill(text: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        text = text.replace("{" + k + "}", v)
    return text.strip()


SPARK = {k: _fill(v, _TYPES[0]) for k, v in SPARK.items()}
CHECK = {k: _fill(v, _TYPES[1]) for k, v in CHECK.items()}
