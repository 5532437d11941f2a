"""The same results in SQL over the same tables, by real joins."""

from __future__ import annotations

from dataclasses import dataclass

PROFILED_STEPS = """
SELECT step, join_type, rows_before, rows_after,
  CASE WHEN rows_before > 0 THEN round(rows_after / rows_before, 6) END AS factor, fanout, equi,
  cardinality, left_max_dup,
  CASE WHEN join_type = 'CROSS' THEN 'cross' WHEN is_natural THEN 'natural'
    WHEN right_dup IS NULL THEN 'not_equality'
    WHEN NOT fanout THEN CASE WHEN right_dup <= 1 THEN 'unique' ELSE 'repeats_without_growth' END
    WHEN right_dup <= 1 THEN 'unique_but_grew'
    WHEN cardinality <> 'many-to-many' THEN 'one_to_many'
    WHEN coalesce(bool_or(fanout) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      false) THEN 'compounded'
    ELSE 'many_to_many' END AS cause
FROM (SELECT *, (join_type = 'CROSS' AND rows_before > 0) OR rows_after > rows_before AS fanout,
  CASE WHEN right_dup IS NULL THEN 'unknown' ELSE
    CASE WHEN left_dup <= 1 THEN 'one' ELSE 'many' END || '-to-' ||
    CASE WHEN right_dup <= 1 THEN 'one' ELSE 'many' END END AS cardinality
FROM ({steps}))
"""


@dataclass
class J:
    """A join clause, its left key expressions, its right table and key columns."""

    type: str
    clause: str
    left: str = ""
    table: str = ""
    keys: str = ""
    equi: bool = True
    natural: bool = False


def worst(source: str, keys: str, non_null: bool) -> str:
    names = [f"x{n}" for n in range(len(keys.split(", ")))]
    cols = ", ".join(f"{k} AS {n}" for k, n in zip(keys.split(", "), names))
    where = " WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in names) if non_null else ""
    return (f"(SELECT coalesce(max(c), 0) FROM (SELECT count(*) AS c FROM (SELECT {cols} FROM {source})"
            f"{where} GROUP BY {', '.join(names)}))")


def steps(driving: str, joins: list[J], with_sql: str = "") -> str:
    rows, before = [], driving
    for n, j in enumerate(joins, 1):
        after = f"{before} {j.clause}"
        keyed = bool(j.keys)
        rows.append(
            f"SELECT {n} AS step, '{j.type}' AS join_type, (SELECT count(*) FROM {before}) AS rows_before, "
            f"(SELECT count(*) FROM {after}) AS rows_after, {str(j.equi and keyed).lower()} AS equi, "
            f"{str(j.natural).lower()} AS is_natural, "
            f"{worst(before, j.left, False) if keyed else 'CAST(NULL AS BIGINT)'} AS left_max_dup, "
            f"{worst(before, j.left, True) if keyed else 'CAST(NULL AS BIGINT)'} AS left_dup, "
            f"{worst(j.table, j.keys, True) if keyed else 'CAST(NULL AS BIGINT)'} AS right_dup")
        before = after
    return with_sql + PROFILED_STEPS.format(steps=" UNION ALL ".join(rows))


CUSTOMER = J("INNER", "JOIN customer c ON o.o_custkey = c.c_custkey", "o.o_custkey", "customer", "c_custkey")
LINEITEM = J("LEFT", "LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey", "o.o_orderkey", "lineitem",
             "l_orderkey")
ORDERS = J("LEFT", "LEFT JOIN orders o ON c.c_custkey = o.o_custkey", "c.c_custkey", "orders", "o_custkey")
EVENTS = J("LEFT", "LEFT JOIN events e ON c.c_custkey = e.user_id", "c.c_custkey", "events", "user_id")
HOT = ("WITH hot AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) "
       "FROM events) ")

TEXTED = ("WITH texted AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN lpad(user_id::VARCHAR, 12, '0') "
          "ELSE user_id::VARCHAR END AS user_text FROM events) ")

SPANS = ("WITH spans AS (SELECT s_suppkey, s_nationkey, s_acctbal AS low, s_acctbal + CASE WHEN s_suppkey % 5 = 0 THEN -80 "
         "ELSE 250 END AS high FROM supplier) ")


def kept_by_key(key: str, fraction: float) -> str:
    """Whether the first 60 bits of the key's md5, as a share of all, lie below the fraction."""
    return f"('0x' || substr(md5({key}::VARCHAR), 1, 15))::BIGINT < ceil({fraction}::DOUBLE * 1152921504606846976::DOUBLE)"


def key_row(table: str, keys: str, source: str | None = None) -> str:
    nulls = " OR ".join(f"{k} IS NULL" for k in keys.split(", "))
    label = f"'{table}' AS table_name, " if source is None else ""
    src = source or table
    return (f"SELECT {label}CAST(coalesce(sum(c), 0) AS BIGINT) AS n_rows, count(*) AS n_keys, "
            f"coalesce(max(c), 0) AS max_dup, coalesce(max(c) FILTER (WHERE NOT ({nulls})), 0) AS "
            f"max_dup_non_null, count(*) FILTER (WHERE c > 1) AS dup_keys, "
            f"CAST(coalesce(sum(c) FILTER (WHERE {nulls}), 0) AS BIGINT) AS null_rows "
            f"FROM (SELECT {keys}, count(*) AS c FROM {src} GROUP BY {keys})")


def fixes(before: str, rows: list[tuple[str, str]], step: int = 1) -> str:
    """Each fix with the SQL that counts its result."""
    parts = [f"SELECT {step} AS step, {n} AS rank, '{kind}' AS kind, ({sql}) AS verified_rows"
             for n, (kind, sql) in enumerate(rows, 1)]
    return (f"SELECT step, rank, kind, verified_rows, round(verified_rows / b, 6) AS verified_factor, "
            f"verified_rows <= b AS restores_grain FROM ({' UNION ALL '.join(parts)}), "
            f"(SELECT count(*) AS b FROM {before})")


def latest(table: str, key: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key}) = 1)"


def grouped(table: str, key: str) -> str:
    return f"(SELECT {key}, count(*) AS n FROM {table} GROUP BY {key})"


def count(source: str) -> str:
    return f"SELECT count(*) FROM {source}"


C_O_E = "customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey LEFT JOIN events e ON c.c_custkey = e.user_id"
O_C_L = ("orders o JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN lineitem l "
         "ON o.o_orderkey = l.l_orderkey")


def risk(expression: str, kind: str, joins: str, base: str | None = None, joined: str | None = None) -> str:
    if base is None:
        return (f"SELECT '{expression}' AS expression, '{kind}' AS kind, '{joins}' AS affected_joins, "
                "CAST(NULL AS DOUBLE) AS base_value, CAST(NULL AS DOUBLE) AS joined_value, "
                "CAST(NULL AS DOUBLE) AS inflation_pct")
    return (f"SELECT '{expression}' AS expression, '{kind}' AS kind, '{joins}' AS affected_joins, "
            f"round(b, 2) AS base_value, round(j, 2) AS joined_value, round((j / b - 1) * 100, 3) AS "
            f"inflation_pct FROM (SELECT CAST(({base}) AS DOUBLE) AS b, CAST(({joined}) AS DOUBLE) AS j)")


def agg(fn: str, base: str, joined: str) -> tuple[str, str]:
    return f"SELECT {fn} FROM {base}", f"SELECT {fn} FROM {joined}"


def section(label: str, joins: int, fanouts: int, before: str, after: str) -> str:
    return (f"SELECT '{label}' AS section, {joins} AS joins, {fanouts} AS fanouts, b AS driving_rows, "
            f"a AS final_rows, round(a / b, 6) AS overall_factor, false AS failed FROM "
            f"(SELECT (SELECT count(*) FROM {before}) AS b, (SELECT count(*) FROM {after}) AS a)")


def clean(label: str, before: str, after: str) -> str:
    return (f"SELECT '{label}' AS section, (SELECT count(*) FROM {before}) AS rows_before, "
            f"(SELECT count(*) FROM {after}) AS rows_after, false AS fanout, 'many-to-one' AS cardinality, "
            "'unique' AS cause")


ALL_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
              "benchmark labels conversations").split()
PER_ORDER = "(SELECT l_orderkey, sum(l_extendedprice) AS price FROM lineitem GROUP BY l_orderkey)"
PAIRS = "(SELECT user_id, event_type FROM events)"

ORACLES: dict[str, str] = {
    "steps_two_joins": steps("orders o", [CUSTOMER, LINEITEM]),
    "steps_compounding": steps("customer c", [ORDERS, EVENTS]),
    "steps_inner": steps("orders o", [J("INNER", "JOIN lineitem l ON o.o_orderkey = l.l_orderkey",
                                        "o.o_orderkey", "lineitem", "l_orderkey")]),
    "steps_clean": " UNION ALL ".join([
        clean("nation", "nation", "nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
        clean("orders", "orders", "orders o JOIN customer c ON o.o_custkey = c.c_custkey")]),
    "steps_many_to_many": steps("customer c", [
        J("INNER", "JOIN supplier s ON c.c_nationkey = s.s_nationkey", "c.c_nationkey", "supplier",
          "s_nationkey")]),
    "steps_cross": steps("customer c", [J("CROSS", "CROSS JOIN supplier s")]),
    "steps_theta": steps("customer c", [J("INNER", "JOIN supplier s ON s.s_acctbal <= c.c_acctbal")]),
    "steps_range_per_key": steps("customer c", [
        J("LEFT", "LEFT JOIN supplier s ON c.c_nationkey = s.s_nationkey AND s.s_acctbal > c.c_acctbal",
          "c.c_nationkey", "supplier", "s_nationkey", equi=False)]),
    "steps_or": steps("customer c", [
        J("LEFT", "LEFT JOIN events e ON c.c_custkey = e.user_id OR e.event_id = c.c_nationkey"),
        J("INNER", "JOIN orders o ON c.c_custkey = o.o_custkey", "c.c_custkey", "orders", "o_custkey")]),
    "agg_inflation_exact": """
WITH o AS (SELECT o_custkey, o_orderkey::HUGEINT * 1000003 + 9007199254740992 AS large, o_totalprice::DECIMAL(20,6) AS price FROM orders),
j AS (SELECT o.* FROM o LEFT JOIN events ON o_custkey = user_id),
v AS (SELECT 0 AS n, sum(large)::VARCHAR AS large, sum(price)::VARCHAR AS price, count(price) AS c, count(*) AS r FROM o
  UNION ALL SELECT 1, sum(large)::VARCHAR, sum(price)::VARCHAR, count(price), count(*) FROM j)
SELECT 'SUM(o.large)' AS expression, max(large) FILTER (WHERE n = 0) AS base_exact, max(large) FILTER (WHERE n = 1) AS joined_exact FROM v
UNION ALL SELECT 'SUM(o.price)', max(price) FILTER (WHERE n = 0), max(price) FILTER (WHERE n = 1) FROM v
UNION ALL SELECT 'COUNT(o.price)', max(c::VARCHAR) FILTER (WHERE n = 0), max(c::VARCHAR) FILTER (WHERE n = 1) FROM v
UNION ALL SELECT 'COUNT(*)', max(r::VARCHAR) FILTER (WHERE n = 0), max(r::VARCHAR) FILTER (WHERE n = 1) FROM v""",
    "qualified_names": steps("orders o", [J("INNER", "JOIN customer c ON o.o_custkey = c.c_custkey", "o.o_custkey", "customer", "c_custkey")]),
    "sampled_keys": f"SELECT o_custkey, count(*) AS n FROM orders WHERE {kept_by_key('o_custkey', 0.05)} GROUP BY o_custkey",
    "validate_sample_by_key": f"""
SELECT (SELECT count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey) AS full_rows,
  (SELECT count(*) FROM (SELECT * FROM customer WHERE {kept_by_key('c_custkey', 0.2)}) LEFT JOIN
    (SELECT * FROM orders WHERE {kept_by_key('o_custkey', 0.2)}) ON c_custkey = o_custkey) AS sample_rows""",
    "steps_mixed_key_types": steps("customer c", [
        J("LEFT", "LEFT JOIN texted e ON c.c_custkey = CAST(e.user_text AS BIGINT)", "c.c_custkey", "texted", "user_text"),
        J("INNER", "JOIN orders o ON CAST(e.user_text AS BIGINT) = o.o_custkey", "CAST(e.user_text AS BIGINT)", "orders", "o_custkey"),
        J("FULL", "FULL JOIN supplier s ON CAST(e.user_text AS BIGINT) = s.s_suppkey", "CAST(e.user_text AS BIGINT)", "supplier",
          "s_suppkey")], TEXTED),
    "key_stats_mixed_types": TEXTED + """
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, max(n) AS max_dup, max(n) FILTER (WHERE user_text IS NOT NULL) AS max_dup_non_null,
  count(*) FILTER (WHERE n > 1) AS dup_keys, coalesce(sum(n) FILTER (WHERE user_text IS NULL), 0)::BIGINT AS null_rows
FROM (SELECT user_text, count(*) AS n FROM texted GROUP BY user_text)""",
    "steps_or_mixed_types": steps("customer c", [
        J("LEFT", "LEFT JOIN texted e ON c.c_custkey = CAST(e.user_text AS BIGINT) OR c.c_nationkey = e.event_id"),
        J("INNER", "JOIN orders o ON c.c_custkey = o.o_custkey", "c.c_custkey", "orders", "o_custkey")], TEXTED),
    "steps_or_five": steps("customer c", [
        J("LEFT", "LEFT JOIN events e ON c.c_custkey = e.user_id OR e.event_id = c.c_nationkey OR c.c_custkey = e.event_id "
                  "OR c.c_nationkey = e.user_id OR e.event_id = c.c_acctbal"),
        J("INNER", "JOIN orders o ON c.c_custkey = o.o_custkey", "c.c_custkey", "orders", "o_custkey")]),
    "steps_or_then_right_side": steps("customer c", [
        J("FULL", "FULL JOIN events e ON c.c_custkey = e.user_id OR e.event_id = c.c_nationkey"),
        J("INNER", "JOIN orders o ON e.user_id = o.o_custkey", "e.user_id", "orders", "o_custkey")]),
    "steps_range_then_right_side": steps("customer c", [
        J("LEFT", "LEFT JOIN supplier s ON s.s_acctbal <= c.c_acctbal"),
        J("INNER", "JOIN nation n ON s.s_nationkey = n.n_nationkey", "s.s_nationkey", "nation", "n_nationkey")]),
    "steps_interval": steps("customer c", [
        J("RIGHT", "RIGHT JOIN supplier s ON c.c_acctbal >= s.s_acctbal AND c.c_acctbal < s.s_acctbal + 250"),
        J("LEFT", "LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey", "s.s_nationkey", "nation", "n_nationkey")]),
    "steps_interval_counted": steps("customer c", [
        J("LEFT", "LEFT JOIN spans s ON c.c_acctbal >= s.low AND c.c_acctbal < s.high"),
        J("RIGHT", "RIGHT JOIN spans n ON c.c_nationkey = n.s_nationkey AND c.c_acctbal BETWEEN n.low AND n.high",
          "c.c_nationkey", "spans", "s_nationkey", equi=False),
        J("INNER", "JOIN orders o ON c.c_custkey = o.o_custkey", "c.c_custkey", "orders", "o_custkey")], SPANS),
    "steps_interval_of_the_left": steps("spans s", [
        J("RIGHT", "RIGHT JOIN customer c ON s.low < c.c_acctbal AND c.c_acctbal <= s.high"),
        J("LEFT", "LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey", "s.s_nationkey", "nation", "n_nationkey")], SPANS),
    "steps_right": steps("lineitem l", [
        J("RIGHT", "RIGHT JOIN orders o ON l.l_orderkey = o.o_orderkey", "l.l_orderkey", "orders",
          "o_orderkey"),
        J("LEFT", "LEFT JOIN events e ON o.o_custkey = e.user_id", "o.o_custkey", "events", "user_id")]),
    "steps_full": steps("events e", [
        J("FULL", "FULL JOIN supplier s ON e.user_id = s.s_suppkey", "e.user_id", "supplier", "s_suppkey"),
        J("LEFT", "LEFT JOIN customer c ON s.s_nationkey = c.c_nationkey", "s.s_nationkey", "customer",
          "c_nationkey"),
        J("FULL", "FULL JOIN orders o ON c.c_custkey = o.o_custkey", "c.c_custkey", "orders",
          "o_custkey")]),
    "steps_using": steps("documents d", [
        J("INNER", "JOIN labels b USING (doc_id)", "doc_id", "labels", "doc_id")]),
    "steps_natural": steps("conversations m", [
        J("INNER", "NATURAL JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) "
                   "AS final", natural=True)]),
    "steps_residual": steps("orders o", [
        J("LEFT", "LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 25",
          "o.o_orderkey", "lineitem", "l_orderkey", equi=False)]),
    "steps_residual_both_sides": steps("orders o", [
        J("LEFT", "LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate > o.o_orderdate "
                  "AND l.l_discount < 0.05", "o.o_orderkey", "lineitem", "l_orderkey", equi=False),
        CUSTOMER]),
    "steps_semi_anti": steps("customer c", [
        J("SEMI", "SEMI JOIN events e ON c.c_custkey = e.user_id", "c.c_custkey", "events", "user_id"),
        ORDERS,
        J("ANTI", "ANTI JOIN supplier s ON c.c_nationkey = s.s_nationkey AND c.c_custkey = s.s_suppkey",
          "c.c_nationkey, c.c_custkey", "supplier", "s_nationkey, s_suppkey")]),
    "steps_multi_key": steps("lineitem a", [
        J("INNER", "JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey",
          "a.l_partkey, a.l_suppkey", "lineitem", "l_partkey, l_suppkey")]),
    "steps_keys_of_siblings": steps("customer c", [
        ORDERS, EVENTS,
        J("LEFT", "LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND e.event_id = l.l_partkey",
          "o.o_orderkey, e.event_id", "lineitem", "l_orderkey, l_partkey"),
        J("LEFT", "LEFT JOIN part p ON l.l_partkey = p.p_partkey", "l.l_partkey", "part", "p_partkey"),
        J("SEMI", "SEMI JOIN labels b ON e.event_id = b.doc_id", "e.event_id", "labels", "doc_id")]),
    "steps_siblings": steps("customer c", [
        ORDERS, EVENTS, LINEITEM,
        J("LEFT", "LEFT JOIN documents d ON e.event_id = d.doc_id", "e.event_id", "documents", "doc_id")]),
    "steps_hot_key": steps("hot e", [
        J("LEFT", "LEFT JOIN orders o ON e.user_id = o.o_custkey", "e.user_id", "orders", "o_custkey"),
        LINEITEM,
        J("INNER", "JOIN documents d ON e.event_id = d.doc_id", "e.event_id", "documents", "doc_id")], HOT),
    "steps_hot_self_join": steps("hot e", [
        J("INNER", "JOIN hot f ON e.user_id = f.user_id", "e.user_id", "hot", "user_id")], HOT),
    "joined_rows": f"SELECT o_orderkey, o_custkey, c_name, l_linenumber, l_quantity FROM {O_C_L}",
    "key_stats_tables": " UNION ALL ".join(key_row(name, keys) for name, keys in {
        "orders": "o_orderkey", "customer": "c_nationkey", "supplier": "s_nationkey",
        "lineitem": "l_orderkey, l_linenumber", "events": "user_id, event_type", "labels": "doc_id",
        "documents": "text", "conversations": "conv_id, turn"}.items()),
    "key_stats_null": key_row("", "user_id", "(SELECT CASE WHEN user_id % 10 <> 0 THEN user_id END AS "
                                             "user_id, value FROM events)"),
    "key_stats_of_audit": " UNION ALL ".join(
        f"SELECT {n} AS step, *, (SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT * "
        f"FROM {table})) AS exact_dup_rows FROM ({key_row('', key, table)})"
        for n, table, key in [(1, "orders", "o_custkey"), (2, "events", "user_id")]),
    "exact_duplicates_events": f"SELECT (SELECT count(*) FROM {PAIRS}) - (SELECT count(*) FROM (SELECT "
                               f"DISTINCT * FROM {PAIRS})) AS exact_dup_rows",
    "exact_duplicates_lineitem": "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT "
                                 "DISTINCT * FROM lineitem)) AS exact_dup_rows",
    "top_keys_events": "SELECT user_id, count(*) AS rows_per_key FROM events GROUP BY user_id "
                       "HAVING count(*) > 1 ORDER BY rows_per_key DESC, user_id LIMIT 10",
    "top_keys_of_audit": " UNION ALL ".join(
        f"SELECT * FROM (SELECT {n} AS step, CAST({key} AS VARCHAR) AS key_value, count(*) AS rows_per_key "
        f"FROM {table} GROUP BY {key} HAVING count(*) > 1 ORDER BY rows_per_key DESC, {key} LIMIT 10)"
        for n, table, key in [(1, "orders", "o_custkey"), (2, "events", "user_id")]),
    "worst_key_rows": "SELECT c_custkey, c_name, event_id, event_type, value FROM customer JOIN events "
                      "ON c_custkey = user_id WHERE user_id = (SELECT user_id FROM events GROUP BY user_id "
                      "ORDER BY count(*) DESC, user_id LIMIT 1)",
    "fix_distinct": fixes("customer", [
        ("distinct", count(f"customer LEFT JOIN (SELECT DISTINCT * FROM {PAIRS}) ON c_custkey = user_id")),
        ("preaggregate", count(f"customer LEFT JOIN {grouped(PAIRS, 'user_id')} ON c_custkey = user_id")),
        ("keep_latest", count(f"customer LEFT JOIN {latest(PAIRS, 'user_id')} ON c_custkey = user_id"))]),
    "fix_grain": fixes("conversations", [
        ("grain", count("conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn")),
        ("grain", count("conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.text = b.text")),
        ("preaggregate", count(f"conversations JOIN {grouped('conversations', 'conv_id')} USING (conv_id)")),
        ("keep_latest", count(f"conversations a JOIN {latest('conversations', 'conv_id')} b USING (conv_id)"))]),
    "fix_drop": fixes("customer", [
        ("drop", count("customer")),
        ("preaggregate", count(f"customer LEFT JOIN {grouped('orders', 'o_custkey')} ON c_custkey = o_custkey")),
        ("keep_latest", count(f"customer LEFT JOIN {latest('orders', 'o_custkey')} ON c_custkey = o_custkey"))]),
    "fix_exists": " UNION ALL ".join(
        f"SELECT '{label}' AS section, step, rank, kind, verified_rows, restores_grain FROM ("
        + fixes(left, [
            ("exists", count(f"{left} WHERE EXISTS (SELECT 1 FROM {right} WHERE {lk} = {rk})")),
            ("preaggregate", count(f"{left} JOIN {grouped(right, rk)} ON {lk} = {rk}")),
            ("keep_latest", count(f"{left} JOIN {latest(right, rk)} ON {lk} = {rk}"))]) + ")"
        for label, left, right, lk, rk in [
            ("orders", "orders", "lineitem", "o_orderkey", "l_orderkey"),
            ("customer", "customer", "events", "c_custkey", "user_id")]),
    "fix_preaggregate": " UNION ALL ".join([
        fixes("customer", [
            ("preaggregate", count(f"customer LEFT JOIN {grouped('orders', 'o_custkey')} "
                                   "ON c_custkey = o_custkey")),
            ("keep_latest", count(f"customer LEFT JOIN {latest('orders', 'o_custkey')} "
                                  "ON c_custkey = o_custkey"))]),
        fixes("customer LEFT JOIN orders ON c_custkey = o_custkey", [
            ("preaggregate", count("customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN "
                                   f"{grouped('events', 'user_id')} ON c_custkey = user_id")),
            ("keep_latest", count("customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN "
                                  f"{latest('events', 'user_id')} ON c_custkey = user_id"))], step=2)]),
    "fix_residual": fixes("orders", [
        ("preaggregate", count("orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) FROM lineitem WHERE "
                               "l_quantity > 25 GROUP BY l_orderkey) ON o_orderkey = l_orderkey")),
        ("keep_latest", count("orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER "
                              "(PARTITION BY l_orderkey ORDER BY l_shipdate DESC) = 1) "
                              "ON o_orderkey = l_orderkey AND l_quantity > 25"))]),
    "fix_keep_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER "
                       "(PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "pre_aggregated_orders": "SELECT o_custkey, max(o_orderpriority) AS o_orderpriority, "
                             "round(sum(o_totalprice), 2) AS o_totalprice, count(*) AS _row_count "
                             "FROM orders GROUP BY o_custkey",
    "rewrite_preaggregate": "SELECT c_mktsegment, round(sum(paid), 2) AS revenue, count(*) AS customers "
                            "FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS paid FROM "
                            "orders GROUP BY o_custkey) ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "agg_inflation": " UNION ALL ".join([
        risk("SUM(c.c_acctbal)", "sum", "1,2", *agg("sum(c.c_acctbal)", "customer c", C_O_E)),
        risk("AVG(c.c_acctbal)", "avg", "1,2", *agg("avg(c.c_acctbal)", "customer c", C_O_E)),
        risk("COUNT(c.c_acctbal)", "count", "1,2", *agg("count(c.c_acctbal)", "customer c", C_O_E)),
        risk("COUNT(*)", "count", "1,2", *agg("count(*)", "customer c", C_O_E))]),
    "agg_inflation_orders": " UNION ALL ".join([
        risk("SUM(o.o_totalprice)", "sum", "2", *agg("sum(o.o_totalprice)", "orders o", O_C_L)),
        risk("SUM(o.o_totalprice * 0.1)", "sum", "2",
             *agg("sum(o.o_totalprice * CAST(0.1 AS DOUBLE))", "orders o", O_C_L)),
        risk("AVG(c.c_acctbal)", "avg", "2")]),
    "agg_risk_rules": " UNION ALL ".join([
        risk("SUM(o.o_totalprice)", "sum", "2"), risk("SUM(e.value)", "sum", "1,2"),
        risk("SUM(value)", "sum", "1,2"), risk("SUM(o.o_totalprice + e.value)", "sum", "1,2"),
        risk("STDDEV(c.c_acctbal)", "stddev", "1,2")]),
    "sections_summary": " UNION ALL ".join([
        section("Main query - UNION branch 1 of 3", 1, 0, "orders",
                f"orders JOIN {PER_ORDER} ON o_orderkey = l_orderkey"),
        section("Main query - UNION branch 2 of 3", 1, 1, "customer",
                "customer LEFT JOIN orders ON c_custkey = o_custkey"),
        section("CTE po", 1, 1, "orders", "orders JOIN lineitem ON o_orderkey = l_orderkey"),
        "SELECT 'Main query - UNION branch 3 of 3', NULL, NULL, NULL, NULL, NULL, true"]),
    "facts_fields": "SELECT b AS driving_rows, a AS final_rows, round(a / b, 3) AS overall_factor, w AS "
                    "worst_key, round((j / s - 1) * 100, 1) AS inflation_pct FROM (SELECT (SELECT count(*) "
                    f"FROM orders) AS b, (SELECT count(*) FROM {O_C_L}) AS a, (SELECT max(c) FROM (SELECT "
                    "count(*) AS c FROM lineitem GROUP BY l_orderkey)) AS w, (SELECT sum(o_totalprice) FROM "
                    f"orders) AS s, (SELECT sum(o_totalprice) FROM {O_C_L}) AS j)",
    "load_folder_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in ALL_TABLES),
    "load_text_files": "SELECT 'buyers_2024' AS table_name, 'int,string,int,double' AS types, c_custkey AS key, c_name AS "
                       "full_name, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'vendors', "
                       "'int,string,int,double', s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
    "registered_names": "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer "
                        "ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "row_count_of_query": "SELECT count(*) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey",
    "sample_coverage_tables": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, least(count(*), 5000) AS sample_rows, count(*) AS full_rows FROM {t}"
        for t in ("customer", "orders", "lineitem", "events", "documents", "labels")),
    "next_month_orders": "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS "
                         "DATE) AS next_month FROM orders",
    "next_month_join": steps("orders o", [
        J("INNER", "JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND date_trunc('month', l.l_shipdate) = "
                   "CAST(date_trunc('month', o.o_orderdate) + INTERVAL 1 MONTH AS DATE)",
          "o.o_orderkey", "lineitem", "l_orderkey", equi=False)]),
}
