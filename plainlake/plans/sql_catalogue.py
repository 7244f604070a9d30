"""The SQL surface, one query for each feature: the text that run_sql takes and its twin for an independent engine.

Both texts give equal column names and types; sums of doubles are rounded, since their order of addition is free.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plainlake.plans.sql_runner import run_sql

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

#: Queries whose text is the same in both dialects.
SAME = {
    "projection": "SELECT o_orderkey, o_totalprice * 2 AS twice, o_orderstatus || '-' || o_orderpriority AS tag FROM orders",
    "between_case": "SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 1000 AND 50000 THEN 'mid' WHEN o_totalprice < 1000 THEN 'low' ELSE 'high' END AS band FROM orders",
    "filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice > 100000 OR o_orderstatus IN ('F', 'P')) AND o_orderpriority LIKE '%1%'",
    "ilike_similar": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment ILIKE 'b%'",
    "is_distinct_from": "SELECT n_nationkey, n_name FROM nation WHERE nullif(n_regionkey, 1) IS DISTINCT FROM 2",
    "inner_join": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "left_join": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
    "right_join": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey",
    "full_join": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL JOIN customer c ON s.s_suppkey = c.c_custkey AND s.s_acctbal < c.c_acctbal",
    "cross_join": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "natural_using": "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)",
    "theta_join": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "scalar_subq": "SELECT c_custkey, c_acctbal FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer d WHERE d.c_nationkey = c.c_nationkey)",
    "exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)",
    "in_subquery": "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "hash_agg": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY l_returnflag",
    "ref_view": "SELECT c.c_custkey, c.c_name, count(o.o_orderkey) AS order_count, round(sum(o.o_totalprice), 2) AS total FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_name",
    "distinct_agg": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS custs FROM orders GROUP BY o_orderstatus",
    "filter_agg": "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS big FROM orders",
    "having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10",
    "group_by_all": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rollup_grouping": "SELECT l_returnflag, l_linestatus, cast(grouping(l_linestatus) AS bigint) AS g, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "stddev_var": "SELECT round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(stddev_pop(l_tax), 8) AS sp, round(var_samp(l_tax), 8) AS vs FROM lineitem",
    "corr_cov": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, round(covar_samp(l_quantity, l_tax), 6) AS cs, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icpt, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem",
    "bool_agg": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS a, bool_or(o_totalprice > 400000) AS o, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderstatus",
    "arg_max": "SELECT o_custkey, max_by(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS best, min_by(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS least FROM orders GROUP BY o_custkey",
    "row_number": "SELECT o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS bigint) AS rn FROM orders",
    "rank_dense": "SELECT l_orderkey, l_linenumber, cast(rank() OVER w AS bigint) AS r, cast(dense_rank() OVER w AS bigint) AS d FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)",
    "percent_ntile": "SELECT c_custkey, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, cast(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS bigint) AS q FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)",
    "lag_lead": "SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS later, first_value(event_id) OVER w AS f, nth_value(event_id, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "frame_rows": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s FROM events",
    "frame_range": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events",
    "nulls_order": "SELECT n_nationkey, cast(row_number() OVER (ORDER BY nullif(n_regionkey, 1) ASC NULLS LAST, n_nationkey) AS bigint) AS rn FROM nation",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25",
    "union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except": "SELECT doc_id AS k FROM documents EXCEPT SELECT doc_id FROM labels",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "cte": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000), c AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM c JOIN customer ON c_custkey = o_custkey",
    "recursive_cte": "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 12) SELECT n, f FROM t",
    "values": "SELECT v.a, v.b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS v(a, b)",
    "str1": "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, cast(length(c_name) AS bigint) AS n, substr(c_name, 3, 5) AS s, replace(c_name, '0', 'o') AS r, trim('  ' || c_mktsegment || ' ') AS t, lpad(cast(c_custkey AS varchar(20)), 8, '*') AS p, reverse(c_name) AS rev, left(c_name, 4) AS lf, right(c_name, 3) AS rg FROM customer",
    "translate_ascii": "SELECT n_nationkey, translate(n_name, 'AEIOU', '12345') AS t, repeat(n_name, 2) AS r, cast(ascii(n_name) AS bigint) AS a FROM nation",
    "md5": "SELECT n_nationkey, md5(n_name) AS m FROM nation",
    "levenshtein": "SELECT a.n_nationkey AS x, b.n_nationkey AS y, cast(levenshtein(a.n_name, b.n_name) AS bigint) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "date_parts": "SELECT o_orderkey, cast(year(o_orderdate) AS bigint) AS y, cast(month(o_orderdate) AS bigint) AS m, cast(day(o_orderdate) AS bigint) AS d, cast(quarter(o_orderdate) AS bigint) AS q FROM orders",
    "math": "SELECT c_custkey, abs(c_acctbal) AS a, cast(ceil(c_acctbal) AS double) AS c, cast(floor(c_acctbal) AS double) AS f, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, round(exp(c_custkey % 5), 6) AS e, power(c_custkey % 7, 2) AS p, c_custkey % 13 AS m, cast(sign(c_acctbal) AS tinyint) AS sg, greatest(c_acctbal, 0.0e0) AS g, least(c_acctbal, 0.0e0) AS le FROM customer",
    "null_fns": "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS c, ifnull(nullif(n_name, 'CHINA'), 'none') AS i FROM nation",
    "try_cast": "SELECT doc_id, try_cast(substr(source, 4) AS bigint) AS n, try_cast(lang AS bigint) AS none FROM documents",
    "cast_round": "SELECT c_custkey, cast(round(c_acctbal, 1) AS decimal(18, 1)) AS d FROM customer",
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT l.l_orderkey, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, o.o_orderdate FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, l.l_orderkey LIMIT 10",
    "tpch_q5": "SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "view_chain": "WITH v1 AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey), v2 AS (SELECT c_nationkey, round(sum(t), 2) AS t FROM v1 JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey), v3 AS (SELECT n_name, t FROM v2 JOIN nation ON n_nationkey = c_nationkey) SELECT n_name, t FROM v3",
}

#: More queries whose text is the same: it is in the other engine's dialect, which run_sql translates.
TRANSLATED = {
    "semi_join": "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey",
    "anti_join": "SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS o ON c_custkey = o.o_custkey",
    "positional_join": "SELECT a.r_name, b.n_name FROM (SELECT r_name FROM region ORDER BY r_regionkey) a POSITIONAL JOIN (SELECT n_name FROM nation ORDER BY n_nationkey) b",
    "skewness": "SELECT round(skewness(l_extendedprice), 6) AS s, round(kurtosis(l_extendedprice), 5) AS k FROM lineitem",
    "median_quantile": "SELECT l_returnflag, median(l_quantity) AS m, round(quantile_cont(l_extendedprice, 0.9), 4) AS p FROM lineitem GROUP BY l_returnflag",
    "mode": "SELECT o_orderstatus, mode(CASE WHEN o_orderkey % 10 < 6 THEN o_orderstatus || ' often' WHEN o_orderkey % 10 < 9 THEN 'at times' ELSE 'rarely' END) AS m FROM orders GROUP BY o_orderstatus",
    "any_value": "SELECT n_regionkey, any_value(r_name) AS v FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey",
    "string_agg": "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey",
    "list_agg": "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name DESC), '|') AS l FROM nation GROUP BY n_regionkey",
    "ignore_nulls": "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events",
    "qualify": "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    "distinct_on": "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey",
    "unnest": "SELECT vec_id, unnest(embedding) AS x FROM embeddings",
    "range_tvf": "SELECT range AS n, range * range AS sq FROM range(0, 50, 5)",
    "str2": "SELECT n_nationkey, concat_ws('/', n_name, CAST(n_regionkey AS VARCHAR)) AS c, CAST(position('A' IN n_name) AS BIGINT) AS p, split_part(n_name, ' ', 1) AS sp, starts_with(n_name, 'I') AS st, string_split(n_name, 'A')[1] AS head FROM nation",
    "regex": "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1) AS d, regexp_extract(c_name, '[0-9]{2}') AS two, regexp_replace(c_name, '[0-9]', '#') AS once, regexp_replace(c_name, '([0-9])', '<\\1>', 'g') AS every, regexp_matches(c_mktsegment, '^[A-M]') AS m FROM customer",
    "sha256": "SELECT n_nationkey, sha256(concat(n_name, upper(n_name))) AS h FROM nation",
    "date_trunc": "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, last_day(CAST(o_orderdate AS DATE)) AS l, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS dd, date_diff('month', TIMESTAMP '1995-01-31 00:00:00', o_orderdate) AS mm, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow FROM orders",
    "date_format": "SELECT o_orderkey, o_orderdate + INTERVAL 1 DAY AS next, strftime(o_orderdate, '%Y/%m/%d at %H:%M') AS f, CAST(epoch(o_orderdate) AS BIGINT) AS e FROM orders",
    "time_bucket": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01 00:00:00') AS b, time_bucket(INTERVAL 7 DAYS, ts) AS w, count(*) AS n FROM events GROUP BY 1, 2",
    "int_div": "SELECT c_custkey, c_custkey // 7 AS d, c_custkey / 7 AS q, c_custkey // 2 * 3 AS t, 2 ^ (c_custkey % 5) AS p FROM customer",
    "float_to_int": "SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS i, (c_custkey / 2)::BIGINT AS half, CAST('2.5' AS BIGINT) AS t, CAST(c_custkey * 0.5 AS BIGINT) AS d FROM customer",
    "div_zero": "SELECT n_nationkey, n_nationkey / n_regionkey > 1e300 AS endless, isnan(n_nationkey / n_regionkey) AS undefined, CASE WHEN n_regionkey > 0 THEN n_nationkey / n_regionkey END AS q FROM nation",
    "null_order": "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY nullif(n_regionkey, 1), n_nationkey) AS BIGINT) AS up, CAST(row_number() OVER (ORDER BY nullif(n_regionkey, 1) DESC, n_nationkey) AS BIGINT) AS down FROM nation",
    "json": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "array_fns": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[2] AS second, embedding[999] AS beyond, list_max(embedding) AS top, list_min(embedding) AS low, list_sum(embedding[2:3]) > 0 AS plus FROM embeddings",
    "hof": "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 6) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS pos FROM embeddings",
    "struct_map": "SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey).a AS a, {'x': n_regionkey}.x AS x, map {'k': n_regionkey}['k'] AS m FROM nation",
    "asof_join": "SELECT e.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type <> 'view') e ASOF LEFT JOIN (SELECT user_id, ts AS seen, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) v ON e.user_id = v.user_id AND e.ts >= v.seen",
    "exclude": "SELECT * EXCLUDE (n_name) FROM nation",
    "list_values": "SELECT n_nationkey, [n_nationkey, n_regionkey, 7][2] AS second, CAST(list_contains([1, 2, 3], n_regionkey) AS BOOLEAN) AS held FROM nation",
}

#: Queries whose text differs: (Spark, twin).
PAIRS = {
    "lateral": (
        "SELECT r.r_name, x.n_name FROM region r, LATERAL (SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_name LIMIT 2) x",
        "SELECT r.r_name, x.n_name FROM region r, LATERAL (SELECT n_name FROM nation n WHERE n.n_regionkey = r.r_regionkey ORDER BY n_name LIMIT 2) x",
    ),
    "summarize_hist": (
        "SELECT cast(least(floor(o_totalprice / 50000), 10) AS bigint) AS bucket, count(*) AS n FROM orders GROUP BY 1",
        "SELECT CAST(least(floor(o_totalprice / 50000), 10) AS BIGINT) AS bucket, count(*) AS n FROM orders GROUP BY 1",
    ),
    "pivot": (
        "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem) PIVOT (count(l_linenumber) FOR l_linestatus IN ('F' AS f, 'O' AS o))",
        "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag",
    ),
    "unpivot": (
        "SELECT s_suppkey, k, v FROM (SELECT s_suppkey, cast(s_nationkey AS double) AS nation, s_acctbal AS bal FROM supplier) UNPIVOT (v FOR k IN (nation, bal))",
        "SELECT s_suppkey, k, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS bal FROM supplier) UNPIVOT (v FOR k IN (nation, bal))",
    ),
    "posexplode": (
        "SELECT vec_id, cast(pos + 1 AS bigint) AS i, x FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x",
        "SELECT vec_id, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS i, unnest(embedding) AS x FROM embeddings",
    ),
    "approx_distinct": ("SELECT abs(approx_count_distinct(o_custkey, 0.01) - count(DISTINCT o_custkey)) <= 0.1 * count(DISTINCT o_custkey) AS close FROM orders", "SELECT abs(approx_count_distinct(o_custkey) - count(DISTINCT o_custkey)) <= 0.3 * count(DISTINCT o_custkey) AS close FROM orders"),
}

#: Queries that no twin can check, as their rows are drawn at random.
ROWS_ONLY = {"tablesample": "SELECT o_orderkey FROM orders TABLESAMPLE (10 PERCENT) REPEATABLE (7)"}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_sql(text, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in text}, spark)


def read_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file named in the statement itself."""
    return run_sql(f"SELECT count(*) AS n, max(o_orderkey) AS k FROM read_parquet('{sf_dir}/orders.parquet')", {}, spark)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    texts = {**SAME, **TRANSLATED, **PAIRS, **ROWS_ONLY}
    return {f"sql_{k}": _query(v if isinstance(v, str) else v[0]) for k, v in texts.items()} | {"sql_read_parquet": read_file}


def oracles() -> dict[str, str]:
    texts = {f"sql_{k}": v if isinstance(v, str) else v[1] for k, v in {**SAME, **TRANSLATED, **PAIRS}.items()}
    return texts | {"sql_read_parquet": "SELECT count(*) AS n, max(o_orderkey) AS k FROM orders"}
