"""The SQL counterpart of each registered query, written from the definitions and not from the plans."""

from __future__ import annotations

from tierworks.operators.catalog import LAYER_OWNER, LAYER_REFRESH
from tierworks.operators.gold import MONTHS
from tierworks.operators.ledger import METRIC_FAMILY
from tierworks.operators.lineage import PIPELINE_LABELS
from tierworks.plans import assets
from tierworks.plans.commerce import (
    BUDGET_GOALS,
    FALLBACK_YEAR,
    GRADES,
    KPI_NAMES,
    SEGMENT_NAMES,
    SNAPSHOT_YEAR,
    TARGETS,
    TOPICS,
    YEARS,
)

ORACLE: dict[str, str] = {}


# ---- pieces -----------------------------------------------------------------------


def rnd(x: str, digits: int) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def pct(part: str, whole: str, digits: int = 2, scale: int = 100) -> str:
    w = f"greatest(CAST({whole} AS BIGINT), 1)"
    step = 10**digits
    return f"CAST((CAST({part} AS BIGINT) * {2 * scale * step} + {w}) // (2 * {w}) AS DOUBLE) / {step}"


def mean(x: str, digits: int = 4) -> str:
    return rnd(f"CAST(sum(CAST({x} AS DECIMAL(28,4))) AS DOUBLE) / count({x})", digits)


def lookup(key: str, table: dict) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {key} {cases} END"


def lit(v) -> str:
    if isinstance(v, (int, float)):
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v)
    return "'" + str(v).replace("'", "''") + "'"


def target(year: str, code: str) -> str:
    return f"CAST({lookup(year, TARGETS[code])} AS DOUBLE)"


def achieved(value: str, goal: str, floor: float = 1) -> str:
    return f"CASE WHEN {goal} IS NOT NULL THEN {rnd(f'{value} / greatest({goal}, CAST({floor} AS DOUBLE)) * 100', 2)} END"


def status(value: str, goal: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL OR {goal} IS NULL THEN NULL WHEN {value} >= {goal} THEN 'Tercapai' "
        f"WHEN {value} >= {goal} * 0.8::DOUBLE THEN 'On Track' ELSE 'Tidak Tercapai' END"
    )


def count_if(test: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {test}) AS BIGINT)"


def scored(inner: str, value: str, goal: str, keep: str, floor: float = 1) -> str:
    """A fact from a query with tahun and the counts: adds period, target and achievement."""
    return (
        f"SELECT CAST(tahun * 100 + 12 AS INTEGER) AS waktu_id, {keep}, {value}, target_iku, "
        f"{achieved(value, 'target_iku', floor)} AS capaian_iku "
        f"FROM (SELECT *, {goal} AS target_iku FROM ({inner}))"
    )


# ---- facts ------------------------------------------------------------------------

ORDER_YEARS = "SELECT *, CAST(year(o_orderdate) AS INTEGER) AS tahun FROM orders"
LINE_YEARS = "SELECT *, CAST(year(l_shipdate) AS INTEGER) AS tahun FROM lineitem"

KPI1 = scored(
    f"""SELECT tahun, c_nationkey AS nationkey, count(*) AS total_orders,
        {count_if("o_orderstatus = 'F'")} AS orders_filled, {count_if("o_orderstatus = 'O'")} AS orders_open,
        {count_if("o_orderstatus NOT IN ('F','O')")} AS orders_other,
        {pct("count(*) FILTER (WHERE o_orderstatus IN ('F','O'))", "count(*)")} AS pct_settled
        FROM ({ORDER_YEARS}) JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "pct_settled", target("tahun", "KPI-1"), "nationkey, total_orders, orders_filled, orders_open, orders_other",
)
KPI2 = scored(
    f"""SELECT tahun, nationkey, count(*) AS total_customers, {count_if('large')} AS customers_large,
        {count_if('pressing')} AS customers_pressing, {count_if('large OR pressing')} AS customers_met,
        {pct('count(*) FILTER (WHERE large OR pressing)', 'count(*)')} AS pct_met
        FROM (SELECT tahun, c_nationkey AS nationkey, c_acctbal >= 5000 AS large, coalesce(p, false) AS pressing
          FROM customer LEFT JOIN (SELECT o_custkey, min(tahun) AS tahun,
            bool_or(o_orderpriority IN ('1-URGENT','2-HIGH')) AS p FROM ({ORDER_YEARS}) GROUP BY 1) ON o_custkey = c_custkey
          WHERE c_acctbal >= 0) GROUP BY ALL""",
    "pct_met", target("tahun", "KPI-2"), "nationkey, total_customers, customers_large, customers_pressing, customers_met",
)
KPI3_INNER = f"""SELECT tahun, s_nationkey AS nationkey, count(*) AS active_suppliers,
    CAST(sum(a) AS BIGINT) AS suppliers_returned, CAST(sum(b) AS BIGINT) AS suppliers_accepted,
    CAST(sum(c) AS BIGINT) AS suppliers_untaxed, CAST(sum(d) AS BIGINT) AS suppliers_discounted,
    {count_if('a + b + c + d > 0')} AS suppliers_met
    FROM (SELECT l_suppkey, tahun, max(CASE WHEN l_returnflag = 'R' AND l_quantity >= 45 THEN 1 ELSE 0 END) AS a,
      max(CASE WHEN l_returnflag = 'A' AND l_quantity >= 48 THEN 1 ELSE 0 END) AS b,
      max(CASE WHEN l_tax = 0 AND l_quantity >= 49 THEN 1 ELSE 0 END) AS c,
      max(CASE WHEN l_discount >= 0.1::DOUBLE AND l_quantity >= 49 THEN 1 ELSE 0 END) AS d
      FROM ({LINE_YEARS}) GROUP BY ALL) JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"""
KPI3_KEEP = (
    "nationkey, total_suppliers, suppliers_returned, suppliers_accepted, suppliers_untaxed, "
    "suppliers_discounted, suppliers_met"
)
KPI3 = scored(
    f"SELECT *, active_suppliers AS total_suppliers, {pct('suppliers_met', 'active_suppliers')} AS pct_met FROM ({KPI3_INNER})",
    "pct_met", target("tahun", "KPI-3"), KPI3_KEEP,
)
KPI3_ALL = scored(
    f"""SELECT *, heads AS total_suppliers, {pct('suppliers_met', 'heads')} AS pct_met FROM ({KPI3_INNER})
        JOIN (SELECT s_nationkey, count(*) AS heads FROM supplier GROUP BY 1) ON s_nationkey = nationkey""",
    "pct_met", target("tahun", "KPI-3"), KPI3_KEEP,
)


def kpi4(met: str) -> str:
    return scored(
        f"""SELECT {SNAPSHOT_YEAR} AS tahun, *, {pct('suppliers_met', 'total_suppliers')} AS pct_met FROM (
            SELECT s_nationkey AS nationkey, count(*) AS total_suppliers, {count_if('s_acctbal >= 7500')} AS suppliers_premium,
            {count_if('s_acctbal >= 0')} AS suppliers_solvent, {count_if('s_acctbal >= 5000')} AS suppliers_large,
            {met} AS suppliers_met FROM supplier GROUP BY ALL)""",
        "pct_met", f"CAST({TARGETS['KPI-4'][SNAPSHOT_YEAR]} AS DOUBLE)",
        "nationkey, total_suppliers, suppliers_premium, suppliers_solvent, suppliers_large, suppliers_met",
    )


KPI4 = kpi4(f"{count_if('s_acctbal >= 7500')} + {count_if('s_acctbal >= 0')} + {count_if('s_acctbal >= 5000')}")
KPI4_ANY = kpi4(count_if("s_acctbal >= 0"))
KPI5 = scored(
    f"""SELECT *, lines_returned + lines_final AS total_eligible,
        {pct('lines_returned + lines_final', 'total_suppliers', 4, 1)} AS ratio_per_supplier FROM (
        SELECT tahun, n_regionkey AS regionkey, {count_if("l_returnflag = 'R'")} AS lines_returned,
        {count_if("l_linestatus = 'F'")} AS lines_final FROM ({LINE_YEARS}) JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL) JOIN (
        SELECT n_regionkey AS rk, count(*) AS total_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
        ON rk = regionkey""",
    "ratio_per_supplier", target("tahun", "KPI-5"),
    "regionkey, total_suppliers, lines_returned, lines_final, total_eligible", 0.01,
)


def yearly(code: str) -> str:
    return f"(SELECT unnest([{', '.join(map(str, TARGETS[code]))}])::INTEGER AS tahun)"


KPI6 = scored(
    f"""SELECT *, {pct('customers_met', 'total_customers')} AS pct_met FROM {yearly('KPI-6')},
        (SELECT count(DISTINCT c_custkey) AS total_customers FROM customer),
        (SELECT count(DISTINCT o_custkey) AS customers_met FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')""",
    "pct_met", target("tahun", "KPI-6"), "total_customers, customers_met",
)
KPI6_YEAR = f"""SELECT tahun, total_customers, customers_met, pct_met, target_iku, {achieved('pct_met', 'target_iku')} AS capaian_iku FROM (
    SELECT *, {pct('customers_met', 'total_customers')} AS pct_met, {target('tahun', 'KPI-6')} AS target_iku FROM (
    SELECT y.tahun, total_customers, coalesce(n, 0) AS customers_met FROM {yearly('KPI-6')} y
    CROSS JOIN (SELECT count(DISTINCT c_custkey) AS total_customers FROM customer)
    LEFT JOIN (SELECT tahun, count(DISTINCT o_custkey) AS n FROM ({ORDER_YEARS})
      WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY 1) h ON h.tahun = y.tahun))"""
KPI7 = scored(
    f"""SELECT *, {pct('lines_met', 'total_lines')} AS pct_met FROM (
        SELECT *, least(lines_discounted + lines_taxed, total_lines) AS lines_met FROM (
        SELECT tahun, s_nationkey AS nationkey, count(*) AS total_lines, {count_if('l_discount >= 0.07::DOUBLE')} AS lines_discounted,
        {count_if('l_tax >= 0.05::DOUBLE')} AS lines_taxed FROM ({LINE_YEARS}) JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL))""",
    "pct_met", target("tahun", "KPI-7"), "nationkey, total_lines, lines_discounted, lines_taxed, lines_met",
)
LATEST_EVENT = """SELECT event_id, user_id, event_type, ts, value, valid_until, event_type = 'purchase' AS is_buyer FROM (
    SELECT *, ts + INTERVAL 30 DAY AS valid_until,
      row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events
    WHERE ts + INTERVAL 30 DAY >= TIMESTAMP '2024-02-10 00:00:00') WHERE rn = 1"""
KPI8 = scored(
    f"""SELECT *, {pct('users_met', 'total_users')} AS pct_met FROM {yearly('KPI-8')},
        (SELECT count(DISTINCT user_id) AS total_users FROM events),
        (SELECT count(DISTINCT user_id) AS users_met FROM ({LATEST_EVENT}) WHERE is_buyer)""",
    "pct_met", target("tahun", "KPI-8"), "total_users, users_met",
)
BUDGET = f"""SELECT CAST(tahun * 100 + 12 AS INTEGER) AS waktu_id, {lookup('tahun', GRADES)} AS predikat_sakip,
    {rnd('p * 0.95::DOUBLE', 1)} AS nilai_sakip, p AS nilai_kinerja_anggaran, pagu_total, realisasi_total, p AS persen_realisasi,
    'BB' AS target_sakip, {lookup('tahun', BUDGET_GOALS)} AS target_kinerja_anggaran FROM (
    SELECT *, {rnd('realisasi_total / pagu_total * 100', 2)} AS p FROM (
    SELECT tahun, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS pagu_total,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS realisasi_total
    FROM ({LINE_YEARS}) GROUP BY 1))"""

FACT = {
    "KPI-1": (KPI1, "pct_settled", "%"), "KPI-2": (KPI2, "pct_met", "%"), "KPI-3": (KPI3, "pct_met", "%"),
    "KPI-4": (KPI4, "pct_met", "%"), "KPI-5": (KPI5, "ratio_per_supplier", "Rasio"), "KPI-6": (KPI6, "pct_met", "%"),
    "KPI-7": (KPI7, "pct_met", "%"), "KPI-8": (KPI8, "pct_met", "%"),
}


def _recap() -> str:
    grid = ", ".join(
        f"({y}, {i}, {lit(c)}, {lit(KPI_NAMES[c])}, {lit(FACT[c][2])}, CAST({TARGETS[c].get(y, TARGETS[c][FALLBACK_YEAR])} AS DOUBLE))"
        for y in YEARS for i, c in enumerate(FACT)
    )
    rows = " UNION ALL ".join(
        f"SELECT {lit(c)} AS code, waktu_id // 100 AS y, CAST({v} AS DECIMAL(28,4)) AS v, CAST(target_iku AS DECIMAL(28,4)) AS t FROM ({f})"
        for c, (f, v, _) in FACT.items()
    )
    m = "CAST(sum(v) AS DOUBLE) / count(v) AS v, CAST(sum(t) AS DOUBLE) / count(t) AS t"
    return f"""WITH rows_ AS MATERIALIZED ({rows}), per_year AS (SELECT code, y, {m} FROM rows_ GROUP BY ALL),
        per_fact AS (SELECT code, {m} FROM rows_ GROUP BY ALL)
        SELECT CAST((g.y - {YEARS[0]}) * {len(FACT)} + g.i + 1 AS INTEGER) AS fact_id, CAST(g.y * 100 + 12 AS INTEGER) AS waktu_id,
          g.code AS iku_kode, g.name AS iku_nama, {rnd('value', 2)} AS nilai_capaian, {rnd('goal_', 4)} AS nilai_target,
          g.unit AS satuan, {status('value', 'goal_')} AS status_capaian FROM (
        SELECT g.*, coalesce(CASE WHEN p.code IS NOT NULL THEN p.v ELSE f.v END,
            g.goal * (0.85::DOUBLE + (g.y - {YEARS[0]}) * 0.03::DOUBLE)) AS value,
          coalesce(CASE WHEN p.code IS NOT NULL THEN p.t ELSE f.t END, g.goal) AS goal_
        FROM (VALUES {grid}) g(y, i, code, name, unit, goal) LEFT JOIN per_year p ON p.code = g.code AND p.y = g.y
        LEFT JOIN per_fact f ON f.code = g.code) g"""


RECAP = _recap()
CALENDAR = f"""SELECT CAST(m // 12 * 100 + m % 12 + 1 AS INTEGER) AS waktu_id, CAST(m // 12 AS INTEGER) AS tahun,
    CASE WHEN m % 12 + 1 >= 8 OR m % 12 = 0 THEN 'Ganjil' ELSE 'Genap' END AS semester,
    CAST(m % 12 // 3 + 1 AS INTEGER) AS triwulan, CAST(m % 12 + 1 AS INTEGER) AS bulan,
    [{', '.join(lit(x) for x in MONTHS)}][m % 12 + 1] AS nama_bulan
    FROM (SELECT unnest(range(min(year(o_orderdate)) * 12, max(year(o_orderdate)) * 12 + 12)) AS m FROM orders)"""
NATION = """SELECT n_nationkey AS nationkey, n_name AS nation, n_regionkey AS regionkey, r_name AS region
    FROM nation LEFT JOIN region ON r_regionkey = n_regionkey"""
RECAP_YEAR = f"SELECT c.tahun, r.* FROM ({RECAP}) r JOIN ({CALENDAR}) c USING (waktu_id)"

# ---- sources ----------------------------------------------------------------------

ORACLE["raw_scan"] = """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
    CAST(c_acctbal AS VARCHAR) AS c_acctbal, c_mktsegment FROM customer"""
COLUMNS_OF = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}
ORACLE["table_row_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, {n} AS column_count FROM {t}"
    for t, n in COLUMNS_OF.items()
)
ORACLE["table_totals"] = f"""SELECT count(*) AS table_count, CAST(sum(row_count) AS BIGINT) AS total_rows, true AS size_adds_up
    FROM ({ORACLE['table_row_counts']})"""
ORACLE["layer_round_trip"] = "SELECT o_orderkey, o_orderstatus, o_orderstatus IN ('F','O') AS is_settled FROM orders"
PARTY = """SELECT 'c-' || c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_acctbal < 0 AS is_debtor,
    'customer' AS party_type FROM customer UNION ALL
    SELECT 's-' || s_suppkey, s_name, s_nationkey, s_acctbal, s_acctbal < 0, 'supplier' FROM supplier"""
ORACLE["append_union"] = f"SELECT id, name, nationkey, party_type FROM ({PARTY})"
ORACLE["stream_append"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders"
ORACLE["format_round_trip"] = """SELECT unnest(['parquet','orc','json']) AS format, n AS read_row_count, true AS has_bytes
    FROM (SELECT count(*) AS n FROM customer)"""
ORACLE["format_contents"] = """SELECT unnest(['parquet','orc','json']) AS format, * FROM (SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS key_sum,
    CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance, CAST(sum(length(c_name)) AS BIGINT) AS name_length,
    count(*) FILTER (WHERE c_acctbal >= 5000) AS n_large, count(DISTINCT n_name) AS n_nations FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)"""
ORACLE["run_layer_report"] = """SELECT 'customer' AS table_name, count(*) AS row_count, true AS written, NULL::VARCHAR AS error FROM customer
    UNION ALL SELECT 'orders_status', count(*), true, NULL FROM orders UNION ALL SELECT 'broken', NULL, false, 'no such source'"""

# ---- profiles and quality ---------------------------------------------------------

REVIEWED = "documents LEFT JOIN labels USING (doc_id)"


def profile(name: str, source: str, columns: list[str], blank_value: bool = False) -> str:
    parts = []
    for i, c in enumerate(columns, start=1):
        missing = f"count(*) FILTER (WHERE {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')"
        distinct = f"count(DISTINCT coalesce(CAST({c} AS VARCHAR), ''))" if blank_value else f"count(DISTINCT {c})"
        parts.append(
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, {i} AS position, count(*) AS row_count, {missing} AS null_count, "
            f"{pct(missing, 'count(*)')} AS null_pct, {pct(f'count(*) - {missing}', 'count(*)')} AS completeness_pct, "
            f"{distinct} AS distinct_count FROM {source}"
        )
    return " UNION ALL ".join(parts)


DOC_FULL = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
DOC_LABELS = ["doc_id", "lang", "quality", "toxic"]
DOC_SCORES = ["doc_id", "quality", "toxic"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORACLE["run_graph_report"] = """SELECT 'customers' AS table_name, count(*) AS row_count, true AS written, NULL AS error FROM customer
    UNION ALL SELECT 'per_nation', count(DISTINCT c_nationkey), true, NULL FROM customer UNION ALL SELECT 'orders_status', count(*), true, NULL FROM orders
    UNION ALL SELECT 'broken', NULL, false, 'no such source' UNION ALL SELECT 'of_broken', NULL, false, 'source broken was not written'"""
ORACLE["profile_orders"] = profile("orders", "orders", ORDERS)
ORACLE["profile_sketched"] = f"SELECT * EXCLUDE (distinct_count), true AS distinct_is_close, true AS is_ordered FROM ({ORACLE['profile_orders']})"
ORACLE["profile_documents"] = profile("doc_full", REVIEWED, DOC_FULL)
ORACLE["profile_blank_distinct"] = profile("doc_labels", REVIEWED, DOC_LABELS, True)


def table_profile(name: str, source: str, columns: list[str], pii: str) -> str:
    return (
        f"SELECT table_name, max(row_count) AS row_count, count(*) AS column_count, {mean('completeness_pct', 2)} AS completeness, "
        f"'{pii}' AS pii_columns, string_agg(column_name, '|' ORDER BY column_name) AS columns "
        f"FROM ({profile(name, source, columns)}) GROUP BY table_name"
    )


ORACLE["profile_tables"] = " UNION ALL ".join([
    table_profile("doc_full", REVIEWED, DOC_FULL, "source|text"), table_profile("customer", "customer", CUSTOMER, "c_name"),
    table_profile("events", "events", EVENTS, ""),
])


def score(name: str, source: str, columns: list[str]) -> str:
    return (
        f"SELECT table_name, row_count, column_count, quality_score, CASE WHEN row_count = 0 THEN 'REJECT' WHEN quality_score >= 80 THEN 'PASS' "
        f"WHEN quality_score >= 60 THEN 'QUARANTINE' ELSE 'REJECT' END AS status FROM ("
        f"SELECT table_name, max(row_count) AS row_count, count(*) AS column_count, {mean('completeness_pct', 2)} AS quality_score "
        f"FROM ({profile(name, source, columns)}) GROUP BY 1)"
    )


THREE = [("doc_full", DOC_FULL), ("doc_labels", DOC_LABELS), ("doc_scores", DOC_SCORES)]
SCORES = " UNION ALL ".join(
    [score(n, REVIEWED, cols) for n, cols in THREE]
    + [score("empty", "(SELECT * FROM customer WHERE c_custkey IS NULL)", CUSTOMER)]
)
ORACLE["quality_scores"] = f"SELECT table_name, row_count, column_count, quality_score FROM ({SCORES})"
ORACLE["quality_gate"] = f"SELECT table_name, status FROM ({SCORES})"
ORACLE["quality_gated_rows"] = f"""SELECT status AS quality_status, row_count AS n, table_name FROM ({SCORES})
    WHERE status <> 'REJECT' AND table_name <> 'empty'"""
BOTH = f"(SELECT * FROM ({SCORES}) WHERE table_name IN ('doc_full','doc_scores'))"
COMBINED = f"SELECT CAST(sum(row_count) AS BIGINT) AS row_count, {rnd('avg(quality_score)', 2)} AS quality_score, bool_or(status = 'PASS') AS passed FROM {BOTH}"
BY_SCORE = "CASE WHEN quality_score >= 80 THEN 'PASS' WHEN quality_score >= 60 THEN 'QUARANTINE' ELSE 'REJECT' END"
ORACLE["quality_combined"] = f"""SELECT 'mean of both' AS table_name, row_count, quality_score, {BY_SCORE} AS status FROM ({COMBINED})
    UNION ALL SELECT 'any of both', row_count, quality_score, CASE WHEN passed THEN 'PASS' ELSE {BY_SCORE} END FROM ({COMBINED})"""
CLEANED = "(SELECT doc_id, lang, quality, coalesce(toxic, 0) AS toxic, quality = 1 AS is_good FROM documents LEFT JOIN labels USING (doc_id))"
ORACLE["quality_before_after"] = f"""SELECT a.table_name, a.row_count, a.column_count, s.quality_score AS source_score, s.status AS source_status,
    a.quality_score AS completeness_after, 3 AS n_transformations, 'FLAG is_good; FILL toxic; DEDUP on doc_id' AS transformations,
    'doc_labels' AS sources FROM ({score('silver_labels', CLEANED, [*DOC_LABELS, 'is_good'])}) a, ({score('doc_labels', REVIEWED, DOC_LABELS)}) s"""
ORACLE["quality_report"] = f"""SELECT status, status <> 'REJECT' AS written, count(*) AS n_tables, CAST(sum(row_count) AS BIGINT) AS row_count,
    min(quality_score) AS min_score, max(quality_score) AS max_score,
    (SELECT CAST({pct("count(*) FILTER (WHERE status = 'PASS')", "count(*) FILTER (WHERE status IN ('PASS','QUARANTINE'))", 0)} AS INTEGER) FROM ({SCORES})) AS pass_share_pct
    FROM ({SCORES}) GROUP BY status"""
ORACLE["gold_profile"] = f"""SELECT 'fact_kpi1' AS table_name, 'fact' AS table_type, count(*) AS row_count, 10 AS column_count, 10 AS n_schema,
    'silver_orders' AS sources, {mean('pct_settled', 2)} AS sample_value, {status("sum(pct_settled::DECIMAL(28,4))::DOUBLE / count(*)", "sum(target_iku::DECIMAL(28,4))::DOUBLE / count(target_iku)")} AS sample_status FROM ({KPI1})
    UNION ALL SELECT 'dim_nation', 'dimension', count(*), 4, 4, 'raw_nation|raw_region', NULL, NULL FROM ({NATION})"""

# ---- projections, duplicates, joins -----------------------------------------------

ORACLE["project_first_columns"] = "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"
ORACLE["default_column"] = "SELECT 'Aktif' AS status, count(*) AS n FROM supplier"
ORACLE["sample_capped"] = "SELECT true AS within_cap, true AS no_repeat"
ORACLE["sample_of_a_small_table"] = "SELECT * FROM supplier"
ORACLE["dedup_by_key"] = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn
    FROM lineitem) WHERE rn = 1"""
ORACLE["latest_per_key"] = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
    FROM orders) WHERE rn = 1"""
ORACLE["union_normalised"] = f"SELECT party_type, is_debtor, count(*) AS n, {mean('acctbal', 2)} AS avg_acctbal FROM ({PARTY}) GROUP BY ALL"
ORACLE["enrich_left_lookup"] = "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"
SUPPLIER = """SELECT supplier.*, s_acctbal >= 7500 AS is_premium, s_acctbal >= 0 AS is_solvent, s_acctbal >= 5000 AS is_large, coalesce(k, 0) >= 3 AS is_active
    FROM supplier LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey"""
ORACLE["supplier_activity_flag"] = f"SELECT s_suppkey, is_active FROM ({SUPPLIER})"
ORACLE["customer_flag_membership"] = """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'
    AND o_orderpriority IN ('1-URGENT','2-HIGH')) AS has_pressing FROM customer"""
ANY = f"""SELECT l_suppkey AS suppkey, tahun, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS is_returned,
    max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS is_final, max(CASE WHEN l_quantity >= 49 THEN 1 ELSE 0 END) AS is_bulk
    FROM ({LINE_YEARS}) GROUP BY ALL"""
ORACLE["activity_any_flags"] = ANY
ORACLE["fact_activity_flags"] = f"""SELECT tahun, s_nationkey AS nationkey, count(*) AS n, CAST(sum(is_returned) AS BIGINT) AS is_returned,
    CAST(sum(is_final) AS BIGINT) AS is_final, CAST(sum(is_bulk) AS BIGINT) AS is_bulk FROM ({ANY}) JOIN supplier ON s_suppkey = suppkey GROUP BY ALL"""
ORACLE["fact_ratio_per_head"] = f"SELECT waktu_id, regionkey, total_eligible, total_suppliers, ratio_per_supplier FROM ({KPI5})"
ORACLE["orphan_key_check"] = """SELECT p_partkey AS k, 'part' AS side FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
    UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""
ORACLE["join_computed_key"] = f"""SELECT c.tahun, c.semester, f.persen_realisasi FROM ({BUDGET}) f JOIN ({CALENDAR}) c
    ON c.tahun = f.waktu_id // 100 AND c.bulan = f.waktu_id % 100"""
ORACLE["join_level_dedup"] = f"""SELECT waktu_id, r_name AS region, ratio_per_supplier FROM ({KPI5}) JOIN region ON r_regionkey = regionkey"""

# ---- silver and gold --------------------------------------------------------------

ORACLE["silver_customer"] = f"""SELECT c_nationkey, c_custkey, c_name, c_acctbal, c_mktsegment, n_name,
    coalesce({lookup('c_mktsegment', SEGMENT_NAMES)}, c_mktsegment) AS segment_name, n_regionkey AS regionkey, c_acctbal >= 5000 AS is_large
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey"""
ORDERS_STATUS = """SELECT *, o_orderstatus = 'F' AS is_filled, o_orderstatus = 'O' AS is_open, o_orderstatus IN ('F','O') AS is_settled FROM orders"""
ORACLE["silver_orders_status"] = ORDERS_STATUS
ORACLE["silver_supplier"] = SUPPLIER
ORACLE["silver_party_union"] = PARTY
ORACLE["silver_open_orders"] = "SELECT *, o_orderpriority IN ('1-URGENT','2-HIGH') AS is_pressing FROM orders WHERE o_orderstatus = 'O'"
ORACLE["silver_latest_valid"] = LATEST_EVENT
ORACLE["dim_calendar"] = CALENDAR
ORACLE["dim_nation"] = NATION
ORACLE["dim_supplier"] = f"SELECT s_suppkey AS suppkey, s_name AS supplier, s_nationkey AS nationkey, is_premium, is_solvent, is_large FROM ({SUPPLIER})"
ORACLE["dim_customer"] = "SELECT c_custkey AS custkey, c_nationkey AS nationkey, c_mktsegment AS segment FROM customer"
ORACLE["dim_topic"] = f"""SELECT p_type AS topic, topic_id, description, count(*) AS n_parts FROM part
    LEFT JOIN (VALUES {', '.join(f'({a}, {lit(b)}, {lit(d)})' for a, b, d in TOPICS)}) t(topic_id, topic, description) ON topic = p_type GROUP BY ALL"""
ORACLE["fact_outcome_by_year"] = f"""SELECT tahun, count(*) AS total, {count_if("o_orderstatus = 'F'")} AS filled, {count_if("o_orderstatus = 'O'")} AS open,
    {count_if("o_orderstatus = 'P'")} AS rest, {pct("count(*) FILTER (WHERE o_orderstatus IN ('F','O'))", "count(*)")} AS pct_settled FROM ({ORDER_YEARS}) GROUP BY ALL"""
for _i in range(1, 9):
    ORACLE[f"fact_kpi{_i}"] = FACT[f"KPI-{_i}"][0]
ORACLE["fact_kpi3_all_heads"] = KPI3_ALL
ORACLE["fact_kpi4_any"] = KPI4_ANY
ORACLE["fact_share_of_entities"] = KPI6_YEAR
ORACLE["fact_budget"] = BUDGET
ORACLE["fact_keys_unique"] = " UNION ALL ".join(
    f"SELECT count(*) AS n_rows, count(*) AS n_keys, '{n}' AS fact FROM ({q})"
    for n, q in (*((f"kpi{i}", FACT[f"KPI-{i}"][0]) for i in range(1, 9)), ("budget", BUDGET))
)
ORACLE["kpi_targets"] = f"""SELECT kpi, year, n_orders, target FROM (SELECT tahun AS year, count(*) AS n_orders FROM ({ORDER_YEARS}) GROUP BY 1)
    CROSS JOIN (SELECT unnest([{', '.join(lit(k) for k in TARGETS)}]) AS kpi)
    LEFT JOIN (VALUES {', '.join(f'({lit(k)}, {y}, CAST({v} AS DOUBLE))' for k, t in TARGETS.items() for y, v in t.items())}) t(kpi, year, target) USING (kpi, year)"""
ORACLE["kpi_status"] = f"""SELECT waktu_id, nationkey, {status('pct_met', '72')} AS status, coalesce({status('pct_met', 'target_iku')}, 'no target') AS status_own FROM ({KPI7})"""


def sample(name: str, fact: str, value: str, unit: str) -> str:
    m = {c: f"CAST(sum(CAST({c} AS DECIMAL(28,4))) AS DOUBLE) / count({c})" for c in (value, "target_iku", "capaian_iku")}
    return (
        f"SELECT {rnd(m[value], 2)} AS nilai_capaian, {rnd(m['target_iku'], 2)} AS nilai_target, {rnd(m['capaian_iku'], 2)} AS persen_capaian_terhadap_target, "
        f"{status(m[value], m['target_iku'])} AS status_capaian, '{unit}' AS satuan, '{name}' AS table_name FROM ({fact})"
    )


ORACLE["kpi_sample"] = " UNION ALL ".join([
    sample("fact_kpi1", KPI1, "pct_settled", "%"), sample("fact_kpi5", KPI5, "ratio_per_supplier", "Rasio"), sample("fact_kpi7", KPI7, "pct_met", "%")
])
ORACLE["kpi_recap"] = RECAP

# ---- serving views ----------------------------------------------------------------

ORACLE["v_recap_year"] = f"SELECT tahun, iku_kode, iku_nama, nilai_capaian, nilai_target, satuan, status_capaian FROM ({RECAP_YEAR})"
ORACLE["v_kpi4_by_org"] = f"""SELECT nationkey, nation, regionkey, region, total_suppliers, suppliers_premium, suppliers_solvent, pct_met, target_iku, capaian_iku
    FROM ({KPI4}) JOIN ({NATION}) USING (nationkey)"""
ORACLE["v_budget_year"] = f"""SELECT waktu_id // 100 AS tahun, predikat_sakip, nilai_sakip, pagu_total, realisasi_total, persen_realisasi, target_kinerja_anggaran FROM ({BUDGET})"""
ORACLE["kpi_subset_union"] = " UNION ALL ".join(
    f"""SELECT CAST(waktu_id // 100 AS INTEGER) AS tahun, {mean('pct_met')} AS nilai_capaian, {mean('target_iku')} AS nilai_target, '{c}' AS iku_kode FROM ({FACT[c][0]}) GROUP BY 1"""
    for c in ("KPI-4", "KPI-6")
)
ORACLE["rollup_region_year"] = f"""SELECT regionkey, region, CAST(waktu_id // 100 AS INTEGER) AS tahun, {mean('pct_met')} AS avg_pct_met FROM ({KPI7}) JOIN ({NATION}) USING (nationkey) GROUP BY ALL"""
ORACLE["rollup_avg"] = f"""SELECT region, CAST(sum(total_orders) AS BIGINT) AS total_orders, CAST(sum(orders_filled) AS BIGINT) AS orders_filled,
    {mean('pct_settled')} AS avg_pct_settled, max(capaian_iku) AS max_capaian_iku FROM ({KPI1}) JOIN ({NATION}) USING (nationkey) GROUP BY ALL"""
ORACLE["rollup_recomputed"] = f"""SELECT waktu_id, region, CAST(sum(orders_filled + orders_open) AS BIGINT) AS met, CAST(sum(total_orders) AS BIGINT) AS total_orders,
    CAST(grouping(waktu_id) + grouping(region) AS INTEGER) AS depth, {pct('sum(orders_filled + orders_open)', 'sum(total_orders)')} AS pct_settled
    FROM ({KPI1}) JOIN ({NATION}) USING (nationkey) GROUP BY ROLLUP (waktu_id, region)"""
ORACLE["entity_census"] = " UNION ALL ".join(
    f"SELECT '{t}' AS entitas, count(*) AS jumlah FROM {t}" for t in ("customer", "supplier", "part", "nation", "region")
)


def by_org(code: str, join: str, org: str) -> str:
    fact, value, _ = FACT[code]
    return f"SELECT '{code}' AS iku_kode, CAST(waktu_id // 100 AS INTEGER) AS tahun, {org} AS org, {value} AS value, target_iku, capaian_iku FROM ({fact}) {join}"


ORACLE["v_kpi_by_org_year"] = " UNION ALL ".join(
    # A cohort without a year has no calendar month to join.
    [by_org(c, f"JOIN ({NATION}) USING (nationkey) WHERE waktu_id IS NOT NULL", "nation") for c in ("KPI-1", "KPI-2", "KPI-3", "KPI-7")]
    + [by_org("KPI-5", "JOIN region ON r_regionkey = regionkey", "r_name")]
    + [by_org(c, "", "'all'") for c in ("KPI-6", "KPI-8")]
)
ORACLE["drilldown_vs_institution"] = f"""SELECT nation, region, {mean('pct_met')} AS avg_pct_met, (SELECT {mean('pct_met')} FROM ({KPI7})) AS avg_all
    FROM ({KPI7}) JOIN ({NATION}) USING (nationkey) GROUP BY ALL"""
ORACLE["slice_year"] = f"SELECT 1997 AS tahun, nationkey, pct_settled FROM ({KPI1}) WHERE waktu_id // 100 = 1997"
ORACLE["dice_year_region"] = f"""SELECT 1999 AS tahun, region, nation, total_orders, pct_settled FROM ({KPI1}) JOIN ({NATION}) USING (nationkey)
    WHERE waktu_id // 100 = 1999 AND region = 'ASIA'"""
ORACLE["pivot_year_kpi"] = "SELECT tahun, " + ", ".join(
    f"{mean(f'CASE WHEN iku_kode = {lit(k)} THEN nilai_capaian END')} AS \"{k}\"" for k in TARGETS
) + f" FROM ({RECAP_YEAR}) GROUP BY tahun"
ORACLE["cube_rollup"], ORACLE["cube_subtotals"], ORACLE["cube_dice"] = ORACLE["rollup_avg"], ORACLE["rollup_recomputed"], ORACLE["dice_year_region"]
_years = [f"waktu_id // 100 = {y}" for y in (1995, 1996, 1997)]
ORACLE["cube_pivot"] = "SELECT region, " + ", ".join(
    f"CASE WHEN count_if({y}) > 0 THEN {pct(f'coalesce(sum(orders_filled + orders_open) FILTER (WHERE {y}), 0)', f'coalesce(sum(total_orders) FILTER (WHERE {y}), 0)')} END AS \"{y[-4:]}\"" for y in _years
) + f" FROM ({KPI1}) JOIN ({NATION}) USING (nationkey) GROUP BY region"
ORACLE["key_range"] = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, CAST(min(waktu_id) AS BIGINT) AS min_key, CAST(max(waktu_id) AS BIGINT) AS max_key FROM ({q})"
    for n, q in (("budget", BUDGET), ("calendar", CALENDAR), ("recap", RECAP))
)
ORACLE["star_diagnosis"] = """SELECT unnest(['n_fact','n_dim','n_join','min_fact_key','max_fact_key','min_dim_key','max_dim_key','n_orphan_keys']) AS "check",
    unnest([a, b, c, d, e, f, g, h]) AS value FROM (SELECT (SELECT count(*) FROM orders) AS a, (SELECT count(*) FROM customer) AS b,
    (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS c, (SELECT min(o_custkey) FROM orders) AS d, (SELECT max(o_custkey) FROM orders) AS e,
    (SELECT min(c_custkey) FROM customer) AS f, (SELECT max(c_custkey) FROM customer) AS g,
    (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS h)"""
ORACLE["scenario_parity"] = f"SELECT unnest(['OFF','ON']) AS ctx, n, 0::BIGINT AS only_here FROM (SELECT count(*) AS n FROM ({KPI1}))"
YEAR_MEANS = f"SELECT tahun, CAST(sum(CAST(nilai_capaian AS DECIMAL(28,4))) AS DOUBLE) / count(*) AS v FROM ({RECAP_YEAR}) GROUP BY 1"
DRIFT = f"""WITH m AS MATERIALIZED (SELECT * FROM ({YEAR_MEANS}))
    SELECT tahun, {rnd('v', 6)} AS nilai_capaian, 0 AS is_forecast FROM m UNION ALL
    SELECT CAST(tahun + i AS INTEGER), {rnd('least(100::DOUBLE, v + i * 1.5::DOUBLE)', 2)}, 1 FROM (SELECT * FROM m ORDER BY tahun DESC LIMIT 1), (SELECT unnest([1, 2, 3]) AS i)"""
ORACLE["v_forecast"] = f"SELECT tahun, nilai_capaian, CASE WHEN is_forecast = 1 THEN 'forecast' ELSE 'actual' END AS series_type FROM ({DRIFT})"
ORACLE["v_actual_vs_target"] = f"SELECT tahun, iku_kode, nilai_capaian AS actual, nilai_target AS target FROM ({RECAP_YEAR}) WHERE iku_kode = 'KPI-4'"

# ---- facts refreshed by batches ----------------------------------------------------

for _i in range(1, 9):
    ORACLE[f"refresh_kpi{_i}"] = ORACLE[f"fact_kpi{_i}"]
ORACLE["refresh_budget"], ORACLE["refresh_recap"] = ORACLE["fact_budget"], ORACLE["kpi_recap"]
ORACLE["refresh_changes"] = f"""SELECT CAST(year(l_shipdate) AS INTEGER) AS tahun, s_nationkey AS nationkey, count(*) AS total_lines,
    {count_if('l_discount >= 0.07')} AS lines_discounted, {count_if('l_tax >= 0.05')} AS lines_taxed FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber >= 7 GROUP BY 1, 2"""
ORACLE["scenario_fingerprint"] = "SELECT unnest(['OFF','ON']) AS ctx, n, true AS same FROM (SELECT count(*) AS n FROM customer)"

# ---- workloads and skew -----------------------------------------------------------

ORACLE["w1_skew_join"] = "SELECT c_nationkey AS nationkey, count(*) AS cnt FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1"
ORACLE["w1_skew_rows"] = "SELECT c_nationkey AS nationkey, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey"
ORACLE["w2_group_agg"] = f"SELECT c_nationkey, count(*) AS n, {mean('c_acctbal', 2)} AS avg_acctbal FROM customer GROUP BY 1"
ORACLE["w3_filter_join"] = "SELECT c_nationkey, c_custkey, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 5000"
ORACLE["w4_fact_dim_join"] = f"SELECT nation, count(*) AS n FROM ({KPI1}) JOIN ({NATION}) USING (nationkey) GROUP BY 1"
ORACLE["w5_recap_by_year"] = f"SELECT tahun, {mean('nilai_capaian')} AS avg_value FROM ({RECAP_YEAR}) GROUP BY 1"
ORACLE["w6_recap_status"] = f"SELECT iku_kode, status_capaian, nilai_capaian FROM ({RECAP}) WHERE status_capaian = 'Tidak Tercapai'"
ORACLE["timed_workloads"] = f"""SELECT scenario, workload_id, workload_type, row_count, 'ok' AS status FROM
    (SELECT unnest(['OFF','ON_FULL','ON_COALESCE_ONLY','ON_SKEW_ONLY','ON_DPP_ONLY','ON_LOCAL_SHUFFLE_ONLY']) AS scenario),
    (SELECT 'W1' AS workload_id, 'join' AS workload_type, count(*) AS row_count FROM ({ORACLE['w1_skew_join']})
     UNION ALL SELECT 'W2', 'aggregation', count(*) FROM ({ORACLE['w2_group_agg']}) UNION ALL SELECT 'W3', 'filtering', count(*) FROM ({ORACLE['w3_filter_join']}))"""


def skew(name: str, table: str, key: str) -> str:
    return f"""SELECT '{name}' AS table_name, total AS row_count_total, n AS key_count, low AS min_rows_per_key, high AS max_rows_per_key,
        {rnd('total / n', 2)} AS mean_rows_per_key, {rnd('high / (total / n)', 3)} AS skew_ratio_max_over_mean,
        sorted[least(n - 1, n * 95 // 100) + 1] AS p95_rows_per_key, {rnd('high * 100.0::DOUBLE / total', 2)} AS top_key_share_pct FROM (
        SELECT CAST(sum(c) AS BIGINT) AS total, count(*) AS n, min(c) AS low, max(c) AS high, list(c ORDER BY c) AS sorted
        FROM (SELECT count(*) AS c FROM {table} GROUP BY {key}))"""


ORACLE["key_skew"] = " UNION ALL ".join([
    skew("customer", "customer", "c_nationkey"), skew("orders", "orders", "o_custkey"), skew("lineitem", "lineitem", "l_partkey"), skew("documents", "documents", "lang")
])
ORACLE["top_keys"] = "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
ORACLE["partition_rows"] = "SELECT count(*) AS row_count, true AS spread FROM orders"
ORACLE["skew_injected_counts"] = "SELECT count(*) AS n, 'about 75 %' AS share FROM orders"


def work(tag: str, parity: int) -> str:
    return f"""SELECT event_type AS workload_id, count(*) AS n_{tag}, CAST(round(CAST(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS DECIMAL(38,10)), 3) AS DOUBLE) AS d_{tag}
        FROM events WHERE day(ts) % 2 = {parity} GROUP BY 1"""


ORACLE["workload_compare"] = f"""SELECT workload_id, 'events_' || workload_id AS name, 'aggregation' AS workload_type, d_off AS duration_off_sec, d_on AS duration_on_sec,
    CASE WHEN d_off > 0 AND d_on <> 0 THEN {rnd('(d_off - d_on) / d_off * 100', 2)} END AS speedup_pct,
    {rnd('n_off / d_off', 2)} AS throughput_off, {rnd('n_on / d_on', 2)} AS throughput_on FROM ({work('off', 1)}) FULL JOIN ({work('on', 0)}) USING (workload_id)"""
ORACLE["speedup_throughput"] = f"""SELECT o_custkey, CASE WHEN base > 0 AND other IS NOT NULL THEN {rnd('(base - other) / base * 100', 2)} END AS speedup_pct,
    CASE WHEN base > 0 THEN {rnd('n / (base / 1000)', 2)} END AS per_1000 FROM (SELECT o_custkey, count(*) AS n,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE tahun = 1996) AS DOUBLE) AS base,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (WHERE tahun = 1997) AS DOUBLE) AS other FROM ({ORDER_YEARS}) GROUP BY 1)"""

# ---- prediction -------------------------------------------------------------------

ORACLE["ml_preflight"] = "SELECT 'dim_customer' AS table_name, true AS found, count(*) AS row_count FROM customer UNION ALL SELECT 'not_there', false, NULL"
FEATURES = f"""SELECT tahun, iku_kode AS iku_code, nilai_capaian, nilai_target FROM ({RECAP_YEAR}) WHERE nilai_capaian IS NOT NULL AND nilai_target IS NOT NULL"""
ORACLE["features_sink"] = FEATURES
ORACLE["ml_features"] = f"""SELECT *, {rnd('nilai_capaian - nilai_target', 4)} AS gap, lag(nilai_capaian, 1) OVER (PARTITION BY iku_code ORDER BY tahun) AS lag_1,
    lag(nilai_capaian, 2) OVER (PARTITION BY iku_code ORDER BY tahun) AS lag_2 FROM ({FEATURES})"""
ORACLE["forecast_drift"] = DRIFT
ORACLE["forecast_trend"] = f"""SELECT iku_code, CAST(last_year + i AS INTEGER) AS tahun, {rnd('b + a * (last_year + i)', 4)} AS forecast, {rnd('last_value', 4)} AS naive FROM (
    SELECT iku_code, coalesce(regr_slope(nilai_capaian, tahun), 0) AS a, coalesce(regr_intercept(nilai_capaian, tahun), avg(nilai_capaian)) AS b,
    max(tahun) AS last_year, max_by(nilai_capaian, tahun) AS last_value FROM ({FEATURES}) GROUP BY 1), (SELECT unnest([1, 2, 3]) AS i)"""
FITTED = f"""SELECT nationkey, tahun, pct_met, {rnd('b + a * tahun', 2)} AS fitted FROM (SELECT nationkey, CAST(waktu_id // 100 AS INTEGER) AS tahun, pct_met FROM ({KPI7}))
    JOIN (SELECT nationkey AS nk, coalesce(regr_slope(pct_met, waktu_id // 100), 0) AS a, coalesce(regr_intercept(pct_met, waktu_id // 100), avg(pct_met)) AS b
    FROM ({KPI7}) GROUP BY 1) ON nk = nationkey"""


def exact(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,8))) AS DOUBLE)"


A, P = "pct_met", "fitted"
ORACLE["forecast_metrics"] = f"""SELECT nationkey, n, {rnd('ae / n', 4)} AS mae, {rnd('sqrt(se / n)', 4)} AS rmse, {rnd('ape / n_ape', 4)} AS mape, {rnd('sape / n_sape', 4)} AS smape,
    CASE WHEN spread > 0 THEN {rnd('1 - se / spread', 4)} END AS r2 FROM (SELECT nationkey, count(*) AS n, {exact(f'abs({A} - {P})')} AS ae,
    {exact(f'({A} - {P}) * ({A} - {P})')} AS se, {exact(f'CASE WHEN {A} <> 0 THEN abs({A} - {P}) / abs({A}) * 100 END')} AS ape, count(*) FILTER (WHERE {A} <> 0) AS n_ape,
    {exact(f'CASE WHEN abs({A}) + abs({P}) <> 0 THEN abs({A} - {P}) * 200 / (abs({A}) + abs({P})) END')} AS sape, count(*) FILTER (WHERE abs({A}) + abs({P}) <> 0) AS n_sape,
    {exact(f'{A} * {A}')} - {exact(A)} * {exact(A)} / count(*) AS spread FROM ({FITTED}) GROUP BY 1)"""
ORACLE["risk_label"] = f"SELECT waktu_id, nationkey, CAST(pct_met < 72 AS INTEGER) AS risk_label FROM ({KPI7})"
Z = """SELECT *, CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0 END AS z FROM (SELECT e.event_id, e.event_type, e.value, s / n AS m,
    sqrt(greatest((q - s * (s / n)) / n, 0)) AS sd FROM events e JOIN (SELECT event_type, count(value) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS s,
    CAST(sum(CAST(CAST(value AS DECIMAL(18,4)) * CAST(value AS DECIMAL(18,4)) AS DECIMAL(38,8))) AS DOUBLE) AS q FROM events GROUP BY 1) USING (event_type))"""
ORACLE["anomaly_z"] = f"SELECT event_id, event_type, value, 1 AS is_anomaly, {rnd(rnd('z', 4), 2)} AS z FROM ({Z}) WHERE abs({rnd('z', 4)}) > 3"
RATE = f"""SELECT event_type, count(*) AS total_records, {count_if(f"abs({rnd('z', 4)}) > 3")} AS anomaly_count,
    {rnd(f"count(*) FILTER (WHERE abs({rnd('z', 4)}) > 3) * 100.0::DOUBLE / count(*)", 2)} AS anomaly_rate_pct FROM ({Z}) GROUP BY 1"""
ORACLE["anomaly_rate"] = RATE
ORACLE["anomaly_residual"] = f"""SELECT nationkey, tahun, {rnd(rnd('pct_met - fitted', 4), 2)} AS residual, CAST(abs(pct_met - fitted) > rmse * 2 AS INTEGER) AS is_anomaly FROM ({FITTED})
    JOIN (SELECT nationkey AS nk, sqrt({exact('(pct_met - fitted) * (pct_met - fitted)')} / count(*)) AS rmse FROM ({FITTED}) GROUP BY 1) ON nk = nationkey"""
TYPES = "(SELECT event_type, count(*) AS n, min(user_id) AS low FROM events GROUP BY 1)"
ORACLE["insight_long"] = f"""SELECT 'opportunity' AS section, event_type AS entity, 'default' AS metric, CAST(low AS DOUBLE) AS value FROM {TYPES}
    UNION ALL SELECT 'anomaly', event_type, 'total', n FROM {TYPES} UNION ALL SELECT 'anomaly', event_type, 'anomaly_count', anomaly_count FROM ({RATE})
    UNION ALL SELECT 'anomaly', event_type, 'rate', anomaly_rate_pct FROM ({RATE}) UNION ALL SELECT 'risk_score', CAST(nationkey AS VARCHAR), 'value', pct_met FROM ({KPI4})"""

_vec = {"kpi1": (KPI1, "pct_settled"), "kpi3": (KPI3, "pct_met"), "kpi4": (KPI4, "pct_met"), "kpi7": (KPI7, "pct_met")}
_means = f"({NATION})" + "".join(f" LEFT JOIN (SELECT nationkey, {mean(v)} AS {n} FROM ({f}) GROUP BY 1) USING (nationkey)" for n, (f, v) in _vec.items())
_whole = " AND ".join(f"{n} IS NOT NULL" for n in _vec)
_scaled = " + ".join(f"power(1 - CASE WHEN hi_{n} > lo_{n} THEN ({n} - lo_{n}) / (hi_{n} - lo_{n}) ELSE 0.5 END, 2)" for n in _vec)
ORACLE["opportunity_scores"] = f"""SELECT nationkey, {', '.join(_vec)}, CASE WHEN {_whole} THEN {rnd(f'100 * (1 - sqrt(({_scaled}) / {len(_vec)}))', 2)} END AS opportunity_score
    FROM (SELECT nationkey, {', '.join(_vec)} FROM {_means}), (SELECT {', '.join(f'min({n}) AS lo_{n}, max({n}) AS hi_{n}' for n in _vec)} FROM {_means} WHERE {_whole})"""

RISK = f"""SELECT c_custkey, c_acctbal, coalesce(n, 0) AS n_orders, coalesce(n_pressing, 0) AS n_pressing, coalesce(spent, 0) AS spent,
    CAST(settled < 66 AS INTEGER) AS risk_label FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_pressing,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, {pct("count(*) FILTER (WHERE o_orderstatus IN ('F', 'O'))", 'count(*)')} AS settled FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
ORACLE["risk_features"] = RISK
ORACLE["risk_split"] = f"""SELECT c_custkey, risk_label, row_number() OVER (PARTITION BY risk_label ORDER BY md5(c_custkey || '|42'))
    <= (800 * count(*) OVER (PARTITION BY risk_label) + 500) // 1000 AS is_train FROM ({RISK})"""
ORACLE["risk_coverage"] = f"""SELECT count(*) AS n_customers, count(risk_label) AS n_labelled, count(*) FILTER (WHERE c_acctbal IS NULL) AS n_unscored, CAST(0 AS BIGINT) AS n_out_of_range FROM ({RISK})"""
RULE = f"""SELECT risk_label AS label, score, CAST(score >= 40 AS INTEGER) AS prediction FROM (SELECT risk_label, {pct('n_pressing', 'n_orders')} AS score FROM ({RISK}) WHERE risk_label IS NOT NULL)"""
ORACLE["rule_confusion"] = f"SELECT label, prediction, count(*) AS n FROM ({RULE}) GROUP BY 1, 2"
_cell = f"""SELECT k, count(*) FILTER (WHERE label = k) AS actual, count(*) FILTER (WHERE prediction = k) AS guessed, count(*) FILTER (WHERE label = k AND prediction = k) AS hit
    FROM ({RULE}), (SELECT unnest([0, 1]) AS k) GROUP BY 1 HAVING count(*) FILTER (WHERE label = k OR prediction = k) > 0"""
_per = f"""SELECT *, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS pr, CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS re FROM ({_cell})"""
_auc = f"""SELECT sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
    FROM (SELECT score, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (WHERE label = 0) AS DOUBLE) AS neg FROM ({RULE}) GROUP BY 1))"""
_scores = f"""SELECT sum(hit) / sum(actual) AS accuracy, avg(CASE WHEN hit > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) AS f1_macro, avg(pr) AS precision, avg(re) AS recall FROM ({_per})"""
ORACLE["rule_metrics"] = " UNION ALL ".join(
    f"SELECT 'rule' AS model, '{m}' AS metric, {rnd(m, 6)} AS value FROM ({_scores})" for m in ("accuracy", "f1_macro", "precision", "recall")
) + f" UNION ALL SELECT 'rule', 'roc_auc', {rnd('auc', 6)} FROM ({_auc})"

# ---- catalog ----------------------------------------------------------------------

S = assets.STORE
_terms = " ".join(f"WHEN '{k}' THEN [{', '.join(lit(t) for t in v)}]" for k, v in assets.TERMS_BY_LANG.items())
# One row per document: the attributes an asset has, without going through JSON.
ASSETS = f"""SELECT *, coalesce(tier, 'other') || '.' || tbl || '@{S}' AS qn, CASE WHEN doc_id % 7 <> 0 THEN tier END AS declared,
    coalesce(CASE WHEN doc_id % 7 <> 0 THEN tier END, CASE WHEN tier IS NULL THEN 'unknown' ELSE tier END) AS at_layer,
    CASE WHEN tier = 'staging' AND doc_id % 3 = 0 THEN 'bronze' ELSE coalesce(tier, 'other') END AS tagged,
    CASE WHEN doc_id % 13 = 0 THEN -1 WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END AS row_count_,
    CASE WHEN doc_id % 23 = 0 OR doc_id % 5 = 0 THEN 0 ELSE 2 END AS n_schema,
    CASE WHEN lang <> 'es' THEN lang END AS owner_, CASE lang {_terms} ELSE [] END AS terms,
    CASE WHEN doc_id % 29 <> 0 THEN stamp END AS ingested, CASE WHEN tier IN ('silver','gold') AND doc_id % 4 <> 0 THEN stamp END AS enriched,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat_ws('/', 'warehouse', tier, tbl) END AS loc,
    CASE WHEN toxic = 1 THEN '' ELSE 'Document in ' || lang END AS descr,
    CASE WHEN tier = 'gold' AND role = 'fact' AND quality = 1 THEN 'KPI-' || (doc_id % 8 + 1) END AS kpi_code,
    CASE WHEN tier = 'gold' AND doc_id % 5 <> 1 THEN role END AS star_role FROM (
    SELECT *, CASE WHEN tier IN ('staging','bronze') THEN 'raw_' || doc_id WHEN tier = 'silver' THEN 'silver_' || doc_id
      WHEN role = 'dimension' THEN 'dim_' || doc_id WHEN role = 'fact' THEN 'fact_kpi' || (doc_id % 8 + 1) || '_' || doc_id ELSE 'misc_' || doc_id END AS tbl,
      strftime(DATE '2024-06-30' - CAST((doc_id * 7919) % 400 AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS stamp FROM (
    SELECT *, CASE WHEN tier = 'gold' THEN CASE WHEN doc_id % 3 = 0 THEN 'dimension' ELSE 'fact' END END AS role FROM (
    SELECT doc_id, lang, source, n_chars, quality, toxic, CASE CAST(substr(source, 4) AS INTEGER) % 5 WHEN 0 THEN 'staging' WHEN 1 THEN 'bronze' WHEN 2 THEN 'silver' WHEN 3 THEN 'gold' END AS tier
    FROM documents LEFT JOIN labels USING (doc_id))))"""
TAGS = """list_filter([upper(tagged[1]) || tagged[2:] || '_Layer', CASE WHEN tagged = 'silver' AND quality = 1 THEN 'Quality_Pass' END,
    CASE WHEN tagged = 'silver' AND quality = 0 THEN 'Quality_Quarantine' END, CASE WHEN tagged IN ('bronze','silver') AND toxic = 1 THEN 'PII' END,
    CASE WHEN tagged = 'gold' AND role = 'dimension' THEN 'Star_Schema_Dimension' END, CASE WHEN tagged = 'gold' AND role = 'fact' THEN 'Star_Schema_Fact' END,
    CASE WHEN tagged = 'gold' AND role = 'fact' THEN 'KPI_Metric' END, CASE WHEN tagged = 'gold' AND role = 'fact' THEN 'Executive_Dashboard' END], lambda x: x IS NOT NULL)"""
TAGGED = f"SELECT *, {TAGS} AS tags FROM ({ASSETS})"
ORACLE["catalog_tags"] = f"SELECT qn AS qualifiedName, array_to_string(tags, '|') AS classifications FROM ({TAGGED})"
SPECS = """SELECT doc_id, slot, CASE slot WHEN 1 THEN 'staging_to_bronze' WHEN 2 THEN 'bronze_to_silver' ELSE 'silver_to_gold' END AS pipeline,
    CASE slot WHEN 1 THEN 'bronze' WHEN 2 THEN 'silver' ELSE 'gold' END AS target, CASE slot WHEN 1 THEN 'raw_' WHEN 2 THEN 'silver_' ELSE 'fact_' END || doc_id AS tbl
    FROM (SELECT doc_id, CAST(substr(source, 4) AS INTEGER) % 5 AS slot FROM documents) WHERE slot BETWEEN 1 AND 3"""
EDGES = f"""SELECT 'etl.' || pipeline || '.' || tbl || '@{S}' AS process, pipeline AS pipeline_name, src_layer || '.' || src || '@{S}' AS src,
    target || '.' || tbl || '@{S}' AS dst, src_layer, target AS dst_layer FROM (
    SELECT *, 'raw_' || doc_id AS src, 'staging' AS src_layer FROM ({SPECS}) WHERE slot = 1
    UNION ALL SELECT *, 'raw_' || doc_id, 'bronze' FROM ({SPECS}) WHERE slot = 2 UNION ALL SELECT *, 'raw_' || (doc_id + 1), 'bronze' FROM ({SPECS}) WHERE slot = 2
    UNION ALL SELECT *, 'silver_' || doc_id, 'silver' FROM ({SPECS}) WHERE slot = 3 AND doc_id % 2 = 0
    UNION ALL SELECT *, 'raw_' || doc_id, 'bronze' FROM ({SPECS}) WHERE slot = 3 AND doc_id % 2 = 0)"""
ORACLE["lineage_edges"] = EDGES


def record(name: str, source: str, columns: list[str], layer: str, kind: str, pii: str, tags: str, desc: str, owner: str, code: str) -> str:
    return f"""SELECT md5('{layer}.{name}@{S}') AS guid, '{layer}.{name}@{S}' AS qualifiedName, {desc} AS description, 'parquet' AS format,
        'warehouse/{layer}/{name}' AS location, row_count, {len(columns)} AS column_count, '{pii}' AS pii_columns, '{tags}' AS classifications,
        '{owner}' AS owner, {code} AS iku_code FROM (SELECT count(*) AS row_count FROM {source})"""


FACT_TAGS = "Gold_Layer|Star_Schema_Fact|KPI_Metric|Executive_Dashboard"
ORACLE["catalog_entities"] = " UNION ALL ".join([
    record("raw_customer", "customer", CUSTOMER, "bronze", "", '["c_name"]', "Bronze_Layer|PII", "'Bronze table: raw_customer'", LAYER_OWNER["bronze"], "NULL"),
    record("raw_orders", "orders", ORDERS, "bronze", "", "[]", "Bronze_Layer", "'Bronze table: raw_orders'", LAYER_OWNER["bronze"], "NULL"),
    record("silver_customer", "customer", ["x"] * 9, "silver", "", '["c_name"]', "Silver_Layer|Quality_Pass|PII", "'Cleaned customers'", "sales", "NULL"),
    record("silver_orders", "orders", ["x"] * 9, "silver", "", "[]", "Silver_Layer|Quality_Pass", "'Silver table: silver_orders'", LAYER_OWNER["silver"], "NULL"),
    record("dim_nation", "nation", ["x"] * 4, "gold", "dimension", "[]", "Gold_Layer|Star_Schema_Dimension", "'Gold table: dim_nation'", LAYER_OWNER["gold"], "NULL"),
    record("fact_kpi1", f"({KPI1})", ["x"] * 10, "gold", "fact", "[]", FACT_TAGS, lit(f"KPI-1: {KPI_NAMES['KPI-1']}"), LAYER_OWNER["gold"], "'KPI-1'"),
])
ORACLE["umt"] = f"""SELECT qn AS asset_qualified_name, at_layer AS layer, row_count_ AS row_count, CASE WHEN tier = 'staging' THEN 'csv' ELSE 'parquet' END AS format,
    CAST(n_schema AS INTEGER) AS n_schema, owner_ AS owner, CAST(len(terms) AS INTEGER) AS n_terms, array_to_string(tags, '|') AS classifications,
    coalesce(enriched, ingested) AS last_enriched_at FROM ({TAGGED})"""
_owner, _refresh = lookup("at_layer", LAYER_OWNER), lookup("at_layer", LAYER_REFRESH)
SIBLING = "at_layer = 'staging' OR (at_layer = 'silver' AND tbl LIKE 'silver\\_%' ESCAPE '\\')"
ORACLE["umt_filled"] = f"""SELECT qn AS asset_qualified_name, at_layer AS layer,
    coalesce(row_count_, CASE WHEN at_layer = 'staging' THEN n_chars + 1 WHEN {SIBLING} THEN n_chars + 2 END) AS row_count,
    CAST(coalesce(CASE WHEN doc_id % 17 <> 0 THEN 2 END, CASE WHEN at_layer = 'staging' THEN 5 WHEN {SIBLING} THEN 7 END) AS INTEGER) AS column_count,
    CASE WHEN tier = 'staging' THEN 'csv' ELSE 'parquet' END AS format,
    CASE WHEN trim(loc) <> '' THEN loc WHEN at_layer = 'staging' THEN 'staging/' || tbl || '.csv' END AS location,
    CAST(CASE WHEN n_schema > 0 THEN n_schema WHEN {SIBLING} THEN 1 ELSE n_schema END AS INTEGER) AS n_schema,
    CASE WHEN toxic = 1 THEN 'text' WHEN {SIBLING} THEN 'a' ELSE '' END AS pii_columns, coalesce(owner_, {_owner}) AS owner,
    'Commerce Lakehouse' AS domain, {_refresh} AS update_frequency FROM ({ASSETS}) WHERE tier IS DISTINCT FROM 'bronze'
    UNION ALL SELECT 'bronze.raw_' || doc_id || '@shadow', 'bronze', n_chars + 2, 7, 'orc', NULL, 1, 'a', {lit(LAYER_OWNER['bronze'])}, 'Commerce Lakehouse', {lit(LAYER_REFRESH['bronze'])} FROM documents"""
ORACLE["catalog_normalise"] = """SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 1 THEN n_chars + 1 ELSE n_chars END AS VARCHAR) AS row_count, source AS qualified, lang,
    CASE WHEN doc_id % 2 = 1 THEN 5 ELSE 5 END AS n_attributes FROM documents"""
VERSIONS = """SELECT 'c' || c_custkey AS guid, 'asset_' || c_custkey AS qn, c_name AS d, c_custkey % 5 AS v, 0 AS side FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'asset_' || s_suppkey, s_name, s_suppkey % 3 + 1, 1 FROM supplier"""
ORACLE["catalog_upsert"] = f"""SELECT arg_min(guid, side * 100 + v) AS guid, qn AS qualifiedName, arg_max(d, v * 10 + side) AS description, CAST(max(v) AS BIGINT) AS version
    FROM ({VERSIONS}) GROUP BY qn"""
ORACLE["catalog_upsert_stored"] = ORACLE["catalog_upsert"]
ORACLE["catalog_merge"] = """SELECT 'g' || k AS guid, arg_max(name, list_) AS name FROM (SELECT p_partkey AS k, p_name AS name, 1 AS list_ FROM part
    UNION ALL SELECT c_custkey, c_name, 2 FROM customer UNION ALL SELECT s_suppkey, s_name, 3 FROM supplier) GROUP BY k"""


def even(x: str) -> str:
    return f"CAST(round_even({x}, 0) AS INTEGER)"


def b(test: str) -> str:
    return f"coalesce(CAST(({test}) AS INTEGER), 0)"


BASE = " + ".join(["3", b("descr <> ''"), b("declared IS NOT NULL"), b("loc <> ''"), b("n_schema > 0"), b("row_count_ IS NOT NULL"), b("ingested IS NOT NULL OR enriched IS NOT NULL")])
BASE = f"({BASE})"
AGE = f"(epoch(TIMESTAMP '{assets.AS_OF[:10]} 00:00:00') - epoch(CAST(left(coalesce(enriched, ingested), 10) AS TIMESTAMP))) / 86400"
QUALITY = f"""SELECT qn AS qualifiedName, lay AS eval_layer,
    CASE lay WHEN 'bronze' THEN {even(f'{BASE} * 100.0::DOUBLE / 9')}
      WHEN 'silver' THEN {even(f"({BASE} + {b('owner_ IS NOT NULL')} + {b('len(terms) > 0')} + {b('tier = ' + lit('silver') + ' AND quality IS NOT NULL')} + {b('tier = ' + lit('silver') + ' AND toxic IS NOT NULL')}) * 100.0::DOUBLE / 13")}
      ELSE {even(f"({BASE} + {b('star_role IS NOT NULL OR kpi_code IS NOT NULL')} + {b('tier = ' + lit('gold') + ' AND quality IS NOT NULL')} + {b('enriched IS NOT NULL')}) * 100.0::DOUBLE / 12")} END AS completeness,
    CASE WHEN n_schema = 0 THEN 0 WHEN row_count_ < 0 THEN 0 WHEN lay = 'bronze' THEN 95 WHEN tier = 'silver' AND quality = 1 THEN 87 WHEN tier = 'silver' AND quality = 0 THEN 70
      WHEN lay = 'silver' THEN 85 WHEN star_role IS NOT NULL OR kpi_code IS NOT NULL THEN 92 ELSE 75 END AS accuracy,
    CASE WHEN coalesce(enriched, ingested) IS NULL THEN 0 WHEN {AGE} <= 7 THEN 100 WHEN {AGE} <= 30 THEN 90 WHEN {AGE} <= 90 THEN 75 WHEN {AGE} <= 180 THEN 60 ELSE 40 END AS timeliness,
    CAST(({b('declared = lay')} + {b('at_layer = lay')} + {b("starts_with(qn, lay || '.')")} + 1 + {b("contains(lower(loc), lay)")}) * 20 AS INTEGER) AS consistency
    FROM ({TAGGED}), (SELECT unnest(['bronze','silver','gold']) AS lay) WHERE tagged = lay"""
ORACLE["meta_quality"] = QUALITY
_names = ("completeness", "accuracy", "timeliness", "consistency")
ORACLE["meta_quality_by_layer"] = f"""SELECT layer, entity_count, {', '.join(_names)}, {', '.join(f"least(5, greatest(1, {even(f'{n} / 20')})) AS {n}_1_5" for n in _names)} FROM (
    SELECT lay AS layer, count(eval_layer) AS entity_count, {', '.join(f"coalesce({even(f'sum({n}) / count({n})')}, 0) AS {n}" for n in _names)}
    FROM (SELECT unnest(['bronze','silver','gold']) AS lay) LEFT JOIN ({QUALITY}) ON eval_layer = lay GROUP BY 1)"""
ORACLE["meta_coverage"] = f"""SELECT at_layer AS layer, count(*) AS entity_count, {pct('count(*) FILTER (WHERE n_schema > 0)', 'count(*)')} AS schema_documented_pct,
    {pct('count(owner_)', 'count(*)')} AS owner_steward_pct, {pct('count(*) FILTER (WHERE len(terms) > 0)', 'count(*)')} AS glossary_term_pct,
    {pct("count(*) FILTER (WHERE list_contains(tags, 'PII'))", 'count(*)')} AS classification_pii_pct FROM ({TAGGED}) WHERE at_layer IN ('bronze','silver','gold') GROUP BY 1"""
ORACLE["lineage_completeness"] = f"""SELECT 'bronze' AS layer, count(*) AS entity_count, {pct('count(*)', 'count(*)')} AS with_incoming_pct,
    {pct('count(*) FILTER (WHERE n_nationkey IN (SELECT c_nationkey FROM customer))', 'count(*)')} AS with_outgoing_pct FROM nation
    UNION ALL SELECT 'silver', count(*), {pct('count(c_nationkey)', 'count(*)')}, {pct('count(*) FILTER (WHERE c_custkey IN (SELECT o_custkey FROM orders))', 'count(*)')} FROM customer
    UNION ALL SELECT 'gold', count(*), {pct('count(o_custkey)', 'count(*)')}, 0 FROM orders"""
ORACLE["catalog_counts"] = f"""SELECT 'type' AS kind, 'lakehouse_dataset' AS label, count(*) AS n FROM documents
    UNION ALL SELECT 'type', 'lakehouse_etl_process', count(DISTINCT process) FROM ({EDGES}) UNION ALL SELECT 'layer', at_layer, count(*) FROM ({ASSETS}) GROUP BY at_layer
    UNION ALL SELECT 'classification', t, count(*) FROM (SELECT unnest(tags) AS t FROM ({TAGGED})) GROUP BY t
    UNION ALL SELECT 'process', pipeline_name, count(DISTINCT process) FROM ({EDGES}) GROUP BY pipeline_name"""
ORACLE["catalog_search"] = f"""(SELECT 'text' AS page, qn AS qualifiedName, tbl AS name FROM ({ASSETS}) WHERE at_layer = 'silver' AND list_contains(terms, 'MBKM') ORDER BY qn LIMIT 20 OFFSET 5)
    UNION ALL (SELECT 'tag', qn, tbl FROM ({TAGGED}) WHERE list_contains(tags, 'Star_Schema_Dimension') ORDER BY qn LIMIT 15)"""
_defs = {t: d for t, (d, _) in assets.TERM_DEFINITIONS.items()}
_cats = {t: c for t, (_, c) in assets.TERM_DEFINITIONS.items()}
TERMS = f"""SELECT term, coalesce({lookup('term', _defs)}, 'Term from metadata: ' || term) AS definition, coalesce({lookup('term', _cats)}, 'Business') AS category,
    'silver_metadata' AS source, qn AS asset FROM (SELECT unnest(terms) AS term, qn FROM ({ASSETS}))
    UNION ALL SELECT kpi_code, 'Indicator ' || kpi_code[5:], 'Business', 'gold_metadata', max(qn) FROM ({ASSETS}) WHERE kpi_code IS NOT NULL GROUP BY kpi_code"""
ORACLE["glossary_terms"] = TERMS
SUMMARY = f"SELECT term, definition, category, source, count(asset) AS n_assets FROM ({TERMS}) GROUP BY ALL"
ORACLE["glossary_summary"] = SUMMARY
ORACLE["glossary_merged"] = f"""SELECT key, coalesce(c.term, m.term, l.term) AS term,
    CASE WHEN c.key IS NOT NULL THEN coalesce(nullif(c.definition, ''), m.definition, l.definition, '') ELSE coalesce(m.definition, l.definition) END AS definition,
    CASE WHEN c.key IS NOT NULL THEN coalesce(nullif(c.category, ''), m.category, l.category, 'Atlas') ELSE coalesce(m.category, l.category) END AS category,
    CASE WHEN c.key IS NOT NULL THEN 'atlas' WHEN m.key IS NOT NULL THEN m.source ELSE 'local' END AS source, c.guid AS guid FROM
    (SELECT lower(term) AS key, * FROM (VALUES {', '.join(f'({lit(t)}, {lit(d)}, {lit(k)})' for t, d, k in assets.LOCAL_TERMS)}) v(term, definition, category)) l
    FULL JOIN (SELECT lower(term) AS key, * FROM ({SUMMARY})) m USING (key)
    FULL JOIN (SELECT lower(term) AS key, * FROM (SELECT CASE WHEN p_type = 'PROMO' THEN 'prodi' ELSE p_type END AS term,
      CASE WHEN p_type <> 'PROMO' THEN 'Parts of type ' || p_type END AS definition, CASE WHEN p_type = 'LARGE' THEN '' ELSE 'Parts' END AS category,
      CAST(min(p_partkey) AS VARCHAR) AS guid FROM part GROUP BY p_type)) c USING (key)"""
TEXT = "lower(concat_ws(' ', qn, tbl, descr, coalesce(declared, ''), array_to_string(terms, ' '), '', kpi_code, 'Indicator ' || kpi_code[5:]))"


def linked(term: str) -> str:
    words = assets.LINK_ALIASES.get(term.lower(), (term.lower(),))
    short = "regexp_matches({}, '(^|[^a-z0-9]){}([^a-z0-9]|$)')"
    tests = " OR ".join(f"contains({TEXT}, {lit(w)})" if len(w) > 2 else short.format(TEXT, w) for w in words)
    return f"SELECT {lit(term)} AS term, qn AS asset FROM ({ASSETS}) WHERE {tests}"


ORACLE["glossary_links"] = f"""SELECT term, asset, CAST(position AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY asset) AS position
    FROM ({' UNION ALL '.join(linked(t) for t in assets.LINK_TERMS)}))"""
ORACLE["catalog_search_paged"], ORACLE["glossary_links_indexed"] = ORACLE["catalog_search"], ORACLE["glossary_links"]
ORACLE["catalog_search_terms"] = f"""SELECT looked_for, count(txt) AS n_assets FROM (SELECT unnest([{', '.join(lit(t) for t in assets.LOOKED_FOR)}]) AS looked_for)
    LEFT JOIN (SELECT {TEXT} AS txt FROM ({ASSETS})) ON contains(txt, lower(looked_for)) GROUP BY looked_for"""
ORACLE["glossary_links_many"] = f"""SELECT term, count(*) AS n_assets, min(qn) AS first_asset FROM (SELECT tbl AS term FROM ({ASSETS}))
    JOIN (SELECT qn, {TEXT} AS txt FROM ({ASSETS})) ON contains(txt, lower(term)) GROUP BY term"""
CARDS = ", ".join(f"({lit(c)}, {lit(n)}, {lit(f)}, CAST({g} AS DOUBLE))" for c, (n, f, g) in assets.KPI_CARDS.items())
ORACLE["kpi_cards"] = f"""SELECT code, kpi_name, fact, qn IS NOT NULL AS registered, coalesce(row_count_, 0) AS row_count, CASE WHEN kpi_code IS NOT NULL THEN n_chars / 100.0::DOUBLE END AS value,
    CASE WHEN kpi_code IS NOT NULL AND doc_id % 2 = 0 THEN 50.0::DOUBLE ELSE goal END AS target, NULL::VARCHAR AS status, CASE WHEN code = 'KPI-5' THEN 'Rasio' ELSE '%' END AS unit,
    qn AS qualifiedName, CASE WHEN qn IS NOT NULL THEN md5(CAST(doc_id AS VARCHAR)) END AS guid FROM (VALUES {CARDS}) d(code, kpi_name, fact, goal) LEFT JOIN (
    SELECT *, 'fact_kpi' || (doc_id % 8 + 1) AS f, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY qn) AS rn FROM ({ASSETS}) WHERE tier = 'gold' AND role = 'fact') ON f = fact AND rn = 1"""
ORACLE["star_counts"] = f"""SELECT count(*) AS gold_count, {count_if("star_role = 'dimension'")} AS dimension_count, {count_if("star_role = 'fact'")} AS fact_count FROM ({ASSETS}) WHERE tier = 'gold'"""
_r, _n = f"'staging.region_' || n_regionkey || '@{S}'", f"'bronze.nation_' || n_nationkey || '@{S}'"
_c, _o = f"'silver.customer_' || c_custkey || '@{S}'", f"'gold.order_' || o_orderkey || '@{S}'"
NC, NCO = "nation JOIN customer ON c_nationkey = n_nationkey", "nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey"
ORACLE["lineage_closure"] = f"""SELECT {_r} AS start, 'down' AS direction, {_n} AS node, 1 AS depth FROM nation UNION ALL SELECT {_r}, 'down', {_c}, 2 FROM {NC}
    UNION ALL SELECT {_r}, 'down', {_o}, 3 FROM {NCO} UNION ALL SELECT {_o}, 'up', {_c}, 1 FROM {NCO} UNION ALL SELECT {_o}, 'up', {_n}, 2 FROM {NCO} UNION ALL SELECT {_o}, 'up', {_r}, 3 FROM {NCO}"""
ORACLE["lineage_rings"] = """SELECT min(c_custkey) OVER ring AS start, 'down' AS direction, c_custkey AS node, CAST(row_number() OVER (ring ORDER BY c_custkey) - 1 AS INTEGER) AS depth
    FROM customer WINDOW ring AS (PARTITION BY c_nationkey, c_mktsegment) QUALIFY row_number() OVER (ring ORDER BY c_custkey) > 1"""
_slots = {p: "etl-" + p.replace("_to_", "-") for p in PIPELINE_LABELS}
ORACLE["lineage_labels"] = f"""SELECT DISTINCT process AS node, {lookup('pipeline_name', PIPELINE_LABELS)} AS label, {lookup('pipeline_name', _slots)} AS layer FROM ({EDGES})
    UNION ALL SELECT DISTINCT dst, dst, dst_layer FROM ({EDGES})"""
ORACLE["lifecycle_stage"] = f"""SELECT qn AS qualifiedName, CAST(stage AS INTEGER) AS stage, CASE WHEN stage <= 4 THEN 'Sandbox' WHEN stage <= 9 THEN 'Enrichment' ELSE 'Production' END AS zone FROM (
    SELECT qn, CASE declared WHEN 'gold' THEN 13 WHEN 'silver' THEN 10 WHEN 'bronze' THEN 7 WHEN 'staging' THEN 4 ELSE 3 END AS stage FROM ({ASSETS}))"""
ORACLE["profile_shape"] = """SELECT doc_id, 'text' AS column_name, n_chars AS null_count, 0.5::DOUBLE AS null_pct, 99.5::DOUBLE AS completeness_pct, doc_id AS distinct_count,
    CASE WHEN doc_id % 2 = 1 THEN 88.5::DOUBLE END AS quality_score, CASE WHEN doc_id % 2 = 1 THEN lang ELSE 'UNKNOWN' END AS quality_status FROM documents"""

# ---- run ledger -------------------------------------------------------------------

RUNS = """SELECT run_id, pipeline, scenario, track, started, ended, CAST(round(epoch(ended - started)::DECIMAL(38,10), 3) AS DOUBLE) AS duration_sec,
    tables_total, CASE WHEN marked > 0 THEN marked ELSE tables_total END AS tables_written, rows_written FROM (
    SELECT 'run-' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, ['staging_to_bronze','bronze_to_silver','silver_to_gold'][user_id % 3 + 1] AS pipeline,
    CASE WHEN day(ts) % 2 = 0 THEN 'ON' ELSE 'OFF' END AS scenario, ['aqe','metadata','mlops'][user_id % 3 + 1] AS track, min(ts) AS started, max(ts) + INTERVAL 90 SECOND AS ended,
    count(*) AS tables_total, count(*) FILTER (WHERE event_type <> 'error') AS marked, CAST(sum(floor(value * 10)) AS BIGINT) AS rows_written FROM events GROUP BY ALL)"""
LAST = "row_number() OVER (PARTITION BY {} ORDER BY ended DESC, run_id DESC) = 1"
ORACLE["ledger_record"] = f"SELECT run_id, pipeline, scenario, track, duration_sec, tables_total, tables_written, rows_written FROM ({RUNS})"
ORACLE["ledger_latest"] = f"SELECT pipeline, scenario, run_id, duration_sec, tables_written, rows_written FROM ({RUNS}) QUALIFY {LAST.format('pipeline, scenario')}"
LATEST = f"SELECT * FROM ({RUNS}) QUALIFY {LAST.format('pipeline')}"
ORACLE["ledger_summary"] = f"""SELECT {rnd('CAST(sum(CAST(duration_sec AS DECIMAL(20,3))) AS DOUBLE)', 3)} AS pipeline_runtime_total_sec, CAST(sum(rows_written) AS BIGINT) AS rows_written,
    count(*) AS pipelines_found, {', '.join(f"max({c}) FILTER (WHERE pipeline = '{p}') AS {p}_{c}" for p in assets.PIPELINES for c in ('run_id', 'duration_sec'))} FROM ({LATEST})"""
ORACLE["ledger_runs"] = f"""SELECT run_id, track, pipeline, scenario, duration_sec, tables_total, {LAST.format('track')} AS is_latest FROM ({RUNS})"""
ORACLE["ledger_artifacts"] = """SELECT DISTINCT 'run-' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id, ['aqe','metadata','mlops'][user_id % 3 + 1] AS track, event_type AS table_name
    FROM events WHERE event_type <> 'error'"""
ORACLE["metrics_long"] = f"""WITH l AS (SELECT * FROM ({RUNS}) QUALIFY {LAST.format('track, scenario')})
    SELECT run_id AS run, pipeline, scenario AS aqe_scenario, metric, {rnd('value', 4)} AS value, coalesce({lookup('metric', METRIC_FAMILY)}, 'pipeline') AS metric_family FROM (
    SELECT *, 'pipeline_duration_seconds' AS metric, duration_sec AS value FROM l UNION ALL SELECT *, 'rows_written', rows_written FROM l
    UNION ALL SELECT *, 'accuracy', tables_written / tables_total FROM l UNION ALL SELECT *, 'mae', tables_total FROM l WHERE tables_total > 1)"""
ORACLE["metrics_exposition"] = f"""SELECT 'lakehouse_tables{{run="' || run_id || '",pipeline="' || pipeline || '"}} ' || CAST(CAST(tables_total AS DOUBLE) AS VARCHAR) AS line FROM ({RUNS})"""
ORACLE["silver_run_summary"] = f"""SELECT scenario, duration_sec, workload_sec, n_workloads, (SELECT max(skew_ratio_max_over_mean) FROM ({ORACLE['key_skew']})) AS max_skew_ratio FROM (
    SELECT scenario, duration_sec FROM ({RUNS}) WHERE pipeline = 'bronze_to_silver' QUALIFY {LAST.format('scenario')}) FULL JOIN (
    SELECT 'OFF' AS scenario, {rnd('CAST(sum(CAST(d_off AS DECIMAL(20,3))) AS DOUBLE)', 3)} AS workload_sec, count(*) AS n_workloads FROM ({work('off', 1)})
    UNION ALL SELECT 'ON', {rnd('CAST(sum(CAST(d_on AS DECIMAL(20,3))) AS DOUBLE)', 3)}, count(*) FROM ({work('on', 0)})) USING (scenario)"""
ORACLE["flagship"] = f"""SELECT CAST(waktu_id // 100 AS INTEGER) AS tahun, region, nation, total_orders, pct_settled, target_iku, capaian_iku, {status('pct_settled', 'target_iku')} AS status
    FROM ({KPI1}) JOIN ({NATION}) USING (nationkey)"""
