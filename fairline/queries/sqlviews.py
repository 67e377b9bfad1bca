"""The derived views as DuckDB common table expressions (the independent side of each check)."""

FIXTURES = """
fixtures AS (
  SELECT o_orderkey AS fixture_id, n_name AS league, n_regionkey AS region,
    'C' || o_custkey AS home, 'V' || ((o_custkey * 7 + 3) % 1000) AS away,
    CAST(o_orderdate AS DATE) AS match_day,
    epoch_us(o_orderdate) + (10 + o_orderkey % 14) * 3600000000 AS kickoff_us,
    lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) >= 7 THEN 0 ELSE 1 END) % 100 AS VARCHAR), 2, '0')
      || lpad(CAST((year(o_orderdate) - CASE WHEN month(o_orderdate) >= 7 THEN 0 ELSE 1 END + 1) % 100 AS VARCHAR), 2, '0') AS season,
    o_orderstatus AS status, substr(o_orderpriority, 1, 1) AS priority,
    CAST(o_orderkey % 5 AS INTEGER) AS home_goals, CAST((o_orderkey // 5) % 4 AS INTEGER) AS away_goals
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

QUOTES = """
raw_quotes AS (
  SELECT l_orderkey AS fixture_id, l_linenumber AS line_no, l_partkey AS part_id, l_suppkey AS supp_id,
    CAST(l_quantity AS INTEGER) AS qty, l_returnflag AS returnflag,
    130 + l_partkey % 250 AS oh, 280 + l_suppkey % 100 AS od, 130 + (l_partkey * 7) % 250 AS oa,
    150 + l_partkey % 101 AS ahh, 150 + (l_partkey * 3 + l_suppkey) % 101 AS aha,
    150 + (l_suppkey * 7 + l_partkey) % 101 AS ov, 150 + (l_suppkey * 3 + l_partkey * 5) % 101 AS un,
    l_linenumber - 4 AS ahq, 8 + l_linenumber % 6 AS ouq
  FROM lineitem),
quotes AS (
  SELECT fixture_id, line_no, part_id, supp_id, qty, returnflag,
    oh / 100e0 AS open_h, od / 100e0 AS open_d, oa / 100e0 AS open_a,
    (oh + qty % 5 - 2) / 100e0 AS close_h, (od - (qty % 5 - 2)) / 100e0 AS close_d, (oa - (qty % 5 - 2)) / 100e0 AS close_a,
    ahq / 4e0 AS home_line, (ahq + qty % 3 - 1) / 4e0 AS close_home_line,
    ahh / 100e0 AS ah_home, aha / 100e0 AS ah_away,
    (ahh + qty % 5 - 2) / 100e0 AS close_ah_home, (aha - (qty % 5 - 2)) / 100e0 AS close_ah_away,
    ouq / 4e0 AS ou_line, (ouq + qty % 2) / 4e0 AS close_ou_line,
    ov / 100e0 AS over_price, un / 100e0 AS under_price,
    (ov + qty % 5 - 2) / 100e0 AS close_over, (un - (qty % 5 - 2)) / 100e0 AS close_under
  FROM raw_quotes)
"""

MARKET = """
market_base AS (
  SELECT q.*, f.* EXCLUDE (fixture_id),
    (1e0 / open_h) / (1e0 / open_h + 1e0 / open_d + 1e0 / open_a) AS fair_h,
    (1e0 / open_d) / (1e0 / open_h + 1e0 / open_d + 1e0 / open_a) AS fair_d,
    (1e0 / open_a) / (1e0 / open_h + 1e0 / open_d + 1e0 / open_a) AS fair_a,
    (1e0 / open_h + 1e0 / open_d + 1e0 / open_a) - 1e0 AS overround
  FROM quotes q JOIN fixtures f ON q.fixture_id = f.fixture_id),
market_rows AS (
  SELECT *, favorite_close_line - favorite_ah_line AS ah_line_move, close_ou_line - ou_line AS ou_line_move
  FROM (SELECT *,
    CASE WHEN favorite_side = 'H' THEN fair_h ELSE fair_a END AS favorite_fair_probability,
    CASE WHEN favorite_side = 'H' THEN home_line ELSE -home_line END AS favorite_ah_line,
    CASE WHEN favorite_side = 'H' THEN ah_home ELSE ah_away END AS favorite_ah_price,
    CASE WHEN favorite_side = 'H' THEN ah_away ELSE ah_home END AS favorite_ah_other_price,
    CASE WHEN favorite_side = 'H' THEN close_home_line ELSE -close_home_line END AS favorite_close_line,
    CASE WHEN favorite_side = 'H' THEN close_ah_home ELSE close_ah_away END AS favorite_close_price,
    CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END AS result
    FROM (SELECT *, CASE WHEN fair_h >= fair_a THEN 'H' ELSE 'A' END AS favorite_side FROM market_base)))
"""

SNAPSHOTS = """
snapshot_base AS (
  SELECT event_id, user_id AS fixture_id, 'L' || (user_id % 12) AS league, 'T' || user_id AS home, 'U' || (user_id * 3) AS away,
    event_type AS provider, 'B' || (user_id % 3) AS bookmaker,
    CASE WHEN k % 7 = 0 THEN 'UNVERIFIED' ELSE 'MAINLINE' END AS source_semantics, k % 7 <> 0 AS mainline_verified,
    epoch_us(ts) AS observed_us, 1704067200000000 + (10 + user_id % 20) * 86400000000 + 64800000000 AS kickoff_us,
    CASE WHEN user_id % 2 = 0 AND k <= 90 THEN 'H' ELSE 'A' END AS favorite_side,
    (k % 9 - 4) / 4e0 AS home_line, (-(k % 9 - 4)) / 4e0 AS away_line,
    (150 + event_id % 101) / 100e0 AS home_price, (150 + (event_id * 3) % 101) / 100e0 AS away_price,
    (8 + k % 5) / 4e0 AS ou_line, (160 + k % 81) / 100e0 AS over_price, (160 + (k * 3) % 81) / 100e0 AS under_price,
    value, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)),
snapshots AS (
  SELECT *, (1e0 / price) / (1e0 / price + 1e0 / other) AS fair_probability FROM (
    SELECT *, CASE WHEN favorite_side = 'H' THEN home_line ELSE away_line END AS line,
      CASE WHEN favorite_side = 'H' THEN home_price ELSE away_price END AS price,
      CASE WHEN favorite_side = 'H' THEN away_price ELSE home_price END AS other
    FROM snapshot_base))
"""

SNAPSHOT_RESULTS = """
snapshot_results AS (
  SELECT c_custkey AS fixture_id,
    CAST(c_custkey % 5 AS INTEGER) + CASE WHEN c_acctbal < 0 AND src = 'S2' THEN 1 ELSE 0 END AS ft_home_goals,
    CAST((c_custkey // 5) % 4 AS INTEGER) AS ft_away_goals, src AS result_source
  FROM customer, (VALUES ('S1'), ('S2')) v(src) WHERE c_mktsegment <> 'HOUSEHOLD')
"""

RESULTS = """
results AS (
  SELECT fixture_id, seq, 'S' || seq AS result_source,
    home_goals + CASE WHEN priority = '1' AND seq = 2 THEN 1 ELSE 0 END AS ft_home_goals, away_goals AS ft_away_goals
  FROM fixtures, (VALUES (1), (2)) v(seq) WHERE status <> 'O' AND (seq = 1 OR status = 'P'))
"""

_DEPS = {
    "fixtures": [FIXTURES],
    "quotes": [QUOTES],
    "market_rows": [FIXTURES, QUOTES, MARKET],
    "snapshots": [SNAPSHOTS],
    "snapshot_results": [SNAPSHOT_RESULTS],
    "results": [FIXTURES, RESULTS],
}


def with_views(views: tuple[str, ...], body: str) -> str:
    """Prefix a query body with the CTEs it names."""
    parts: list[str] = []
    for v in views:
        for p in _DEPS[v]:
            if p not in parts:
                parts.append(p)
    body = body.strip()
    if not parts:
        return body
    head = "WITH " + ",".join(p.strip() for p in parts)
    return head + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)


def r(expr: str, digits: int) -> str:
    """Half-up display rounding, as functions.exact.rnd."""
    return f"(floor(({expr}) * 1e{digits} + 0.5e0) / 1e{digits})"


def micro(expr: str) -> str:
    return f"CAST(floor(({expr}) * 1e6 + 0.5e0) AS BIGINT)"


def sum_micro(expr: str) -> str:
    """Exact sum in millionths."""
    return f"CAST(SUM({micro(expr)}) AS BIGINT)"


def avg_micro(expr: str) -> str:
    return f"(CAST(SUM({micro(expr)}) AS DOUBLE) / (CAST(COUNT({expr}) AS DOUBLE) * 1e6))"


def half_signs(margin_q: str, q: str) -> str:
    return f"(sign({margin_q} + {q} - abs({q} % 2)) + sign({margin_q} + {q} + abs({q} % 2)))"


def ah_signs(hg: str, ag: str, line: str, side: str) -> str:
    q = f"CAST(round({line} * 4) AS INTEGER)"
    d = f"(CASE WHEN {side} = 'H' THEN {hg} - {ag} ELSE {ag} - {hg} END * 4)"
    return half_signs(d, q)


def over_signs(hg: str, ag: str, line: str) -> str:
    return half_signs(f"(({hg} + {ag}) * 4)", f"(-CAST(round({line} * 4) AS INTEGER))")


def profit(signs: str, odds: str) -> str:
    return f"(CASE WHEN {signs} > 0 THEN ({odds} - 1e0) * {signs} / 2e0 ELSE {signs} / 2e0 END)"


def klass(signs: str) -> str:
    return (
        f"(CASE {signs} WHEN 2 THEN 'FULL_WIN' WHEN 1 THEN 'HALF_WIN' WHEN 0 THEN 'PUSH' "
        f"WHEN -1 THEN 'HALF_LOSS' ELSE 'FULL_LOSS' END)"
    )


def erfc(x: str) -> str:
    t = f"(1e0 / (1e0 + 0.5e0 * ({x})))"
    cs = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
          0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = f"{cs[-1]!r}e0"
    for c in reversed(cs[:-1]):
        poly = f"({c!r}e0 + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def two_sided_p(z: str) -> str:
    return erfc(f"abs({z}) / sqrt(2e0)")
