"""The registered queries in plain SQL, for checking results on another engine."""

from __future__ import annotations

from plumbline import constants as K
from plumbline.plans import ledger
from plumbline.plans.sql import IDENTIFIER, NUMBER_KINDS, column_facts, roles_of, text, union

BASE = """
base AS (
  SELECT CASE WHEN l.l_returnflag = 'R' AND l.l_partkey % 3 <> 0
              THEN concat('C', CAST(l.l_orderkey AS VARCHAR))
              ELSE CAST(l.l_orderkey AS VARCHAR) END AS InvoiceNo,
         concat('P', CAST(l.l_partkey AS VARCHAR)) AS StockCode,
         CASE WHEN l.l_partkey % 50 = 0 AND l.l_linenumber = 1 THEN upper(p.p_name) ELSE p.p_name END AS Description,
         CASE WHEN l.l_orderkey % 997 = 0 THEN 'bad'
              WHEN l.l_returnflag = 'R' THEN concat('-', CAST(CAST(l.l_quantity AS INT) AS VARCHAR))
              ELSE CAST(CAST(l.l_quantity AS INT) AS VARCHAR) END AS Quantity,
         l.l_shipdate AS InvoiceDate,
         CASE WHEN l.l_suppkey % 97 = 5 THEN -p.p_retailprice
              WHEN l.l_orderkey % 89 = 0 THEN 0.0 ELSE p.p_retailprice END AS UnitPrice,
         CASE WHEN l.l_orderkey % 4 = 0 THEN NULL ELSE o.o_custkey END AS CustomerID,
         n.n_name AS Country,
         l.l_linenumber AS LineNumber, l.l_suppkey AS SuppKey, l.l_orderkey AS OrderKey, l.l_partkey AS PartKey,
         CASE WHEN l.l_returnflag = 'R' THEN -l.l_quantity ELSE l.l_quantity END * p.p_retailprice
           + CASE WHEN l.l_partkey % 25 = 1 THEN 25.0 ELSE 0.0 END AS LineTotal
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                  JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN customer c ON o.o_custkey = c.c_custkey
                  JOIN nation n ON c.c_nationkey = n.n_nationkey),
retail AS (
  SELECT row_number() OVER (ORDER BY OrderKey, PartKey, SuppKey, LineNumber, LineTotal, InvoiceDate, Copy) AS row_number, * EXCLUDE (Copy)
  FROM (SELECT *, 0 AS Copy FROM base
        UNION ALL SELECT *, 1 AS Copy FROM base WHERE OrderKey % 200 = 7))
"""

RETAIL = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID",
          "Country", "LineNumber", "SuppKey", "OrderKey", "PartKey", "LineTotal"]
RETAIL_FIELDS = ["UnitPrice", "SuppKey", "OrderKey", "PartKey", "LineTotal"]
HEADERS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "pages": ["page_id", "url", "html"],
    "region": ["r_regionkey", "r_name"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "labels": ["doc_id", "quality", "toxic"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "retail": RETAIL,
}
TABLES = [t for t in HEADERS if t != "retail"]
def retail(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([BASE.strip(), *ctes]) + "\n" + body


def severity(percent: str) -> str:
    return f"CASE WHEN {percent} >= 20 THEN 'high' WHEN {percent} >= 5 THEN 'medium' ELSE 'low' END"


def grade(score: str) -> str:
    return (f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} >= 95 THEN 'excellent' WHEN {score} >= 85 "
            f"THEN 'good' WHEN {score} >= 70 THEN 'fair' ELSE 'needs_attention' END")


def initcap(expression: str) -> str:
    return (f"list_aggregate(list_transform(string_split(replace({expression}, '_', ' '), ' '), "
            f"lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')")


# --- catalog -----------------------------------------------------------------------
CATALOG = """
catalog AS (
  SELECT doc_id AS id, concat(source, ' ', lang, ' doc', doc_id, '.csv') AS file_name,
    CASE lang WHEN 'fr' THEN concat('uploads/', source, '/../doc', doc_id, '.csv')
              WHEN 'de' THEN concat('uploads/', source, '/../../outside/doc', doc_id, '.csv')
              WHEN 'es' THEN concat('uploads/./', source, '//doc', doc_id, '.csv')
              ELSE concat('uploads/', source, '/doc', doc_id, '.csv') END AS file_path,
    length(text) - length(replace(text, chr(10), '')) + 1 AS rows_count,
    length(text) - length(replace(text, ',', '')) + 1 AS columns_count,
    strlen(text) AS content_length, sha256(text) AS content_sha
  FROM documents),
valid AS (
  SELECT * FROM (
    SELECT *, regexp_replace(regexp_replace(replace(replace(file_path, '/./', '/'), '//', '/'),
                             '[^/]+/\\.\\./', ''), '[^/]+/\\.\\./', '') AS resolved_path FROM catalog)
  WHERE starts_with(resolved_path, 'uploads/'))
"""
CHOSEN = """
chosen AS (SELECT max(id) AS id, content_length, content_sha FROM catalog
           GROUP BY content_length, content_sha ORDER BY count(*) DESC, content_sha LIMIT 1),
marked AS (SELECT c.id, CASE WHEN c.content_length = k.content_length AND c.content_sha = k.content_sha
                             THEN 'removed' ELSE 'kept' END AS status
           FROM catalog c, chosen k)
"""


def catalog(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([CATALOG.strip(), *[c.strip() for c in ctes]]) + "\n" + body


# --- quality -----------------------------------------------------------------------
QTY = "try_cast(Quantity AS DOUBLE)"
MISSING = ", ".join(f"count(*) - count({c}) AS m{i}" for i, c in enumerate(RETAIL))
RULES = f"""
checked AS (
  SELECT *, {QTY} AS qty,
    Quantity IS NOT NULL AND {QTY} IS NULL AS bad_quantity,
    coalesce({QTY} < 0, false) AND NOT starts_with(InvoiceNo, 'C') AS negative_quantity,
    coalesce(UnitPrice < 0, false) AS negative_price,
    {QTY} IS NOT NULL AND UnitPrice IS NOT NULL AS complete,
    {QTY} * UnitPrice AS expected,
    coalesce(abs(LineTotal - {QTY} * UnitPrice) > greatest(0.02, 0.001 * abs(LineTotal)), false) AS mismatch
  FROM retail)
"""
FACTS = RULES.strip() + f""",
counted AS (
  SELECT count(*) AS n, {MISSING},
    count(*) FILTER (bad_quantity) AS bad_quantity,
    count(*) FILTER (negative_quantity) AS negative_quantity,
    count(*) FILTER (negative_price) AS negative_price,
    count(*) FILTER (bad_quantity OR negative_quantity OR negative_price) AS invalid_rows,
    count(*) FILTER (UnitPrice = 0) AS zero_price,
    count(*) FILTER (complete) AS complete_rows,
    count(*) FILTER (mismatch) AS mismatches,
    (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM retail GROUP BY {", ".join(RETAIL)})) AS dups,
    (SELECT count(*) FROM (SELECT 1 FROM retail GROUP BY StockCode)) AS codes,
    (SELECT count(*) FROM (SELECT 1 FROM retail GROUP BY StockCode HAVING count(DISTINCT Description) > 1)) AS bad_codes
  FROM checked),
covered AS (
  SELECT *, {" + ".join(f"m{i}" for i in range(len(RETAIL)))} AS missing,
    100 * (1 - ({" + ".join(f"m{i}" for i in range(len(RETAIL)))}) / (n * {len(RETAIL)})) AS coverage,
    100.0 * greatest({", ".join(f"m{i}" for i in range(len(RETAIL)))}) / n AS worst
  FROM counted),
penalised AS (SELECT *, least(15.0, 0.6 * greatest(0.0, worst - (100 - coverage))) AS penalty FROM covered),
scored AS (
  SELECT *, round(greatest(0.0, coverage - penalty), 2) AS completeness,
    round(100 * (1 - dups / n), 2) AS uniqueness,
    round(100 * (1 - invalid_rows / n), 2) AS validity,
    round(100 * (1 - bad_codes / codes), 2) AS product_score,
    round(100 * (1 - mismatches / complete_rows), 2) AS totals_score,
    round((round(100 * (1 - bad_codes / codes), 2) + round(100 * (1 - mismatches / complete_rows), 2)) / 2, 2)
      AS consistency
  FROM penalised),
dimensions AS (
  SELECT 1 AS ordinal, 'completeness' AS dimension, CAST(0.3 AS DOUBLE) AS weight, completeness AS score,
    CASE WHEN penalty > 0 THEN {text(K.CONCENTRATED_REASON)} ELSE {text(K.NOT_CONCENTRATED_REASON)} END AS reason FROM scored
  UNION ALL SELECT 2, 'uniqueness', 0.25, uniqueness, NULL FROM scored
  UNION ALL SELECT 3, 'validity', 0.25, validity, {text(K.VALIDITY_CANCELLATION_REASON)} FROM scored
  UNION ALL SELECT 4, 'consistency', 0.2, consistency, {text(K.CONSISTENCY_REASON)} FROM scored),
overall AS (
  SELECT (sum(score * weight ORDER BY ordinal) / sum(weight)) AS mean, min(score) AS lowest,
    arg_min(dimension, (score, ordinal)) AS limiting FROM dimensions),
ranked_columns AS (
  {" UNION ALL ".join(f"SELECT {i + 1} AS ordinal, '{c}' AS column_name, m{i} AS missing, n FROM counted"
                      for i, c in enumerate(RETAIL))}),
issues AS (
  SELECT ordinal, 'completeness' AS dimension, {severity("round(100.0 * missing / n, 2)")} AS severity, column_name,
    missing AS affected_records,
    concat(column_name, ' is missing in ', CAST(round(100.0 * missing / n, 2) AS VARCHAR), '% of records.') AS message
  FROM ranked_columns
  UNION ALL SELECT 14, 'uniqueness', {severity("100.0 * dups / n")}, NULL, dups,
    concat(dups, ' duplicate rows were detected.') FROM scored
  UNION ALL SELECT 15, 'validity', {severity("100.0 * negative_quantity / n")}, 'Quantity', negative_quantity,
    {text(K.NEGATIVE_QUANTITY_ISSUE)} FROM scored
  UNION ALL SELECT 16, 'validity', {severity("100.0 * negative_price / n")}, 'UnitPrice', negative_price,
    {text(K.NEGATIVE_PRICE_ISSUE)} FROM scored
  UNION ALL SELECT 17, 'validity', {severity("100.0 * bad_quantity / n")}, 'Quantity', bad_quantity,
    concat('Quantity contains ', bad_quantity, ' nonnumeric or non-finite values.') FROM scored
  UNION ALL SELECT 19, 'validity', 'info', 'UnitPrice', zero_price, {text(K.ZERO_PRICE_ISSUE)} FROM scored
  UNION ALL SELECT 20, 'consistency', {severity("100.0 * bad_codes / codes")}, NULL, bad_codes,
    'StockCode values associated with multiple Description values were detected.' FROM scored
  UNION ALL SELECT 21, 'consistency', {severity("100.0 * mismatches / complete_rows")}, 'LineTotal', mismatches,
    concat(mismatches, ' comparable LineTotal values differ from Quantity × UnitPrice.') FROM scored),
found AS (SELECT * FROM issues WHERE affected_records > 0),
ranked AS (SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END
           AS severity_rank FROM found)
"""


def quality(body: str) -> str:
    return retail(body, FACTS.strip())


# --- profile -----------------------------------------------------------------------
def cell(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S')" if column == "InvoiceDate" else f"CAST({column} AS VARCHAR)"


LONG = "long AS (" + union(
    f"SELECT {i} AS ordinal, row_number, {cell(c)} AS value FROM retail WHERE {c} IS NOT NULL"
    for i, c in enumerate(RETAIL, 1)) + ")"
MISSING_ROWS = "missing_rows AS (" + union(
    f"SELECT {i} AS ordinal, '{c}' AS column_name, count(*) AS rows_count, count(*) - count({c}) AS missing_count, "
    f"round(100.0 * (count(*) - count({c})) / count(*), 2) AS missing_percentage, "
    f"count(DISTINCT {c}) AS unique_count, any_value(typeof({c})) AS kind, "
    f"count(try_cast(CAST({c} AS VARCHAR) AS TIMESTAMP)) / count({c}) AS date_share FROM retail"
    for i, c in enumerate(RETAIL, 1)) + ")"
LOGICAL = ("typed AS (SELECT *, CASE WHEN " + IDENTIFIER + " THEN 'identifier' "
           f"WHEN kind IN ('DATE', 'TIMESTAMP') THEN 'datetime' WHEN kind IN {NUMBER_KINDS} OR kind = 'BOOLEAN' THEN 'numeric' "
           f"WHEN date_share >= {K.DATE_PROBE_SHARE} THEN 'datetime' "
           f"WHEN unique_count <= {K.CATEGORY_MAX_DISTINCT} OR unique_count / rows_count <= {K.CATEGORY_MAX_SHARE} THEN 'categorical' "
           "ELSE 'text' END AS logical_type, CASE kind WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' "
           "WHEN 'INTEGER' THEN 'int' ELSE lower(kind) END AS data_type FROM missing_rows)")
ORDER_TEXTS = """
order_texts AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS row_number, o_orderkey,
    strftime(o_orderdate, '%Y-%m-%d') AS iso_day,
    concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate), strftime(o_orderdate, ' %-H:%M')) AS us_minute,
    CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE strftime(o_orderdate, '%Y/%m/%d') END AS partly,
    o_orderpriority, o_orderdate
  FROM orders)
"""


def numeric_row(ordinal: int, column: str, source: str) -> str:
    measures = {"mean": f"avg({column})", "std": f"stddev_samp({column})", "minimum": f"min({column})",
                "q25": f"quantile_cont({column}, 0.25)", "q50": f"quantile_cont({column}, 0.5)",
                "q75": f"quantile_cont({column}, 0.75)", "maximum": f"max({column})"}
    return (f"SELECT {ordinal} AS ordinal, '{column}' AS column_name, count({column}) AS value_count, "
            + ", ".join(f"round({e}, 4) AS {m}" for m, e in measures.items()) + f" FROM {source}")


# --- anomalies ---------------------------------------------------------------------
def bounds_cte(fields: list[str], source: str) -> str:
    rows = []
    for i, f in enumerate(fields, 1):
        v = f"CAST({f} AS DOUBLE)"
        rows.append(
            f"SELECT 'iqr' AS method, {i} AS field_order, '{f}' AS field, count({f}) AS evaluated_rows, "
            f"quantile_cont({v}, 0.25) - 1.5 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)) AS lower_bound, "
            f"quantile_cont({v}, 0.75) + 1.5 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)) AS upper_bound "
            f"FROM {source}")
        rows.append(
            f"SELECT 'z_score', {i}, '{f}', count({f}), avg({v}) - 3.0 * stddev_pop({v}), "
            f"avg({v}) + 3.0 * stddev_pop({v}) FROM {source}")
    return "bounds AS MATERIALIZED (" + union(rows) + ")"


def values_cte(fields: list[str], source: str) -> str:
    return "field_values AS (" + union(
        f"SELECT row_number, {i} AS field_order, CAST({f} AS DOUBLE) AS value FROM {source}"
        for i, f in enumerate(fields, 1)) + ")"


TREES, TREE_ROWS = K.FOREST_TREES, K.FOREST_TREE_ROWS
EULER = "0.5772156649015329"


def average_path(rows: str) -> str:
    return (f"CASE WHEN {rows} <= 1 THEN 0.0 WHEN {rows} = 2 THEN 1.0 ELSE "
            f"2.0 * (ln({rows} - 1.0) + {EULER}) - 2.0 * ({rows} - 1.0) / {rows} END")


def split(source: str, fields: int) -> str:
    """Rows of tree nodes with the field and threshold their node is split by, NULL in leaves."""
    def each(bound):
        return "[" + ", ".join(f"{bound}(x[{i}]) OVER node_rows" for i in range(1, fields + 1)) + "]"

    return f"""(
  SELECT *, CASE WHEN raw >= highs[feature + 1] THEN lows[feature + 1] ELSE raw END AS threshold FROM (
    SELECT *, lows[feature + 1] + share * (highs[feature + 1] - lows[feature + 1]) AS raw FROM (
      SELECT *, CASE WHEN depth < (SELECT depth_limit FROM sizes) AND len(varying) > 0
                     THEN varying[CAST(number % len(varying) AS INT) + 1] END AS feature FROM (
        SELECT *, list_filter(range(0, {fields}), lambda i: lows[i + 1] < highs[i + 1]) AS varying,
          CAST(('0x' || substr(digest, 1, 8)) AS BIGINT) AS number,
          CAST(CAST(('0x' || substr(digest, 9, 12)) AS BIGINT) AS DOUBLE) / CAST(281474976710656 AS DOUBLE) AS share
        FROM (SELECT *, {each('min')} AS lows, {each('max')} AS highs, count(*) OVER node_rows AS node_size,
                md5(concat('{K.SEED}-', tree, '-', node)) AS digest
              FROM {source} WINDOW node_rows AS (PARTITION BY tree, node))))))"""


def forest_ctes(fields: list[str], source: str) -> list[str]:
    """The same forest: rows by digest, 256 a tree, splits from digests, exact 1 % cut-off over all rows."""
    step = "SELECT row_number, x, 0 AS node, tree FROM matrix, range({}) t(tree)".format(TREES)
    for _ in range(8):
        step = (f"SELECT w.row_number, w.x, CASE WHEN m.feature IS NULL THEN w.node WHEN w.x[m.feature + 1] > m.threshold "
                f"THEN 2 * w.node + 2 ELSE 2 * w.node + 1 END AS node, w.tree FROM ({step}) w "
                "JOIN model m ON w.tree = m.tree AND w.node = m.node")
    return [
        f"matrix AS MATERIALIZED (SELECT row_number, [{', '.join(f'CAST({f} AS DOUBLE)' for f in fields)}] AS x FROM {source} "
        f"WHERE {' AND '.join(f + ' IS NOT NULL' for f in fields)})",
        f"sizes AS MATERIALIZED (SELECT least({TREES * TREE_ROWS}, count(*)) AS pool_rows, least({TREE_ROWS}, count(*)) AS tree_rows, "
        f"CAST(ceil(log2(greatest(least({TREE_ROWS}, count(*)), 2))) AS INT) AS depth_limit FROM matrix)",
        f"pool AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY md5(concat(CAST(row_number AS VARCHAR), '-{K.SEED}'))) - 1 AS rank "
        f"FROM matrix QUALIFY rank < {TREES * TREE_ROWS})",
        f"grown AS (SELECT seat.tree, CAST(0 AS BIGINT) AS node, 0 AS depth, x FROM (SELECT tree, (tree * {TREE_ROWS} + place) % pool_rows AS rank "
        f"FROM range({TREES}) t(tree), sizes, range({TREE_ROWS}) p(place) WHERE place < tree_rows) seat JOIN pool ON seat.rank = pool.rank "
        "UNION ALL SELECT tree, 2 * node + CASE WHEN x[feature + 1] > threshold THEN 2 ELSE 1 END, depth + 1, x FROM "
        + split("grown", len(fields)) + " WHERE feature IS NOT NULL)",
        "model AS MATERIALIZED (SELECT tree, node, any_value(feature) AS feature, any_value(threshold) AS threshold, "
        f"any_value(CASE WHEN feature IS NULL THEN depth + {average_path('node_size')} ELSE 0.0 END) AS path FROM "
        + split("grown", len(fields)) + " GROUP BY tree, node)",
        "tree_scores AS MATERIALIZED (SELECT w.row_number, round(-pow(2.0, -(sum(m.path) / " + f"{TREES}.0" + ") / "
        f"(SELECT {average_path('tree_rows')} FROM sizes)), 9) AS score FROM ({step}) w "
        "JOIN model m ON w.tree = m.tree AND w.node = m.node GROUP BY w.row_number)",
        f"forest AS MATERIALIZED (SELECT row_number, round(score - (SELECT quantile_cont(score, {K.FOREST_CONTAMINATION}) FROM tree_scores), 9) "
        "AS forest_score FROM tree_scores)",
    ]


NO_FOREST = ["forest AS (SELECT CAST(0 AS BIGINT) AS row_number, CAST(NULL AS DOUBLE) AS forest_score WHERE false)"]
# Scores have nine places; half a unit of the sixth goes up, whatever the binary form says.
SIX_PLACES = "-CAST((CAST(round(abs(forest_score) * 1e9) AS BIGINT) + 500) // 1000 AS DOUBLE) / 1e6"
SIGNALS = f"""
crossed AS (
  SELECT v.row_number, b.method, b.field, concat(b.method, ':', b.field) AS signal,
    CASE b.method WHEN 'iqr' THEN 1 ELSE 2 END AS method_order, b.field_order, v.value,
    CASE WHEN v.value < b.lower_bound THEN 'below' ELSE 'above' END AS direction,
    CASE WHEN v.value < b.lower_bound THEN b.lower_bound ELSE b.upper_bound END AS boundary,
    concat(b.field, ' is ', CASE WHEN v.value < b.lower_bound THEN 'below' ELSE 'above' END, ' the ',
           CASE b.method WHEN 'iqr' THEN 'IQR' ELSE 'Z-score' END, ' boundary.') AS message
  FROM field_values v JOIN bounds b ON v.field_order = b.field_order
  WHERE v.value < b.lower_bound OR v.value > b.upper_bound
  UNION ALL
  SELECT row_number, 'isolation_forest', '{", ".join(RETAIL_FIELDS)}', 'isolation_forest', 3, 1, {SIX_PLACES}, 'below', 0.0,
    {text(K.FOREST_EVIDENCE)}
  FROM forest WHERE forest_score < 0),
evidence AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY row_number ORDER BY method_order, field_order) AS position FROM crossed),
flagged AS MATERIALIZED (
  SELECT e.row_number, count(*) AS votes, string_agg(signal, ', ' ORDER BY position) AS signals,
    string_agg(message, '; ' ORDER BY position) AS evidence, any_value(forest_score) AS forest_score
  FROM evidence e LEFT JOIN forest f ON e.row_number = f.row_number GROUP BY e.row_number)
"""
FOREST_EVALUATED = ("'" + ", ".join(RETAIL_FIELDS) + "'", "'evaluated'", "CAST(NULL AS VARCHAR)", "(SELECT count(*) FROM forest)",
                    "(SELECT count(*) FROM forest WHERE forest_score < 0)", "(SELECT CAST(pool_rows AS BIGINT) FROM sizes)",
                    f"CAST({K.FOREST_CONTAMINATION} AS DOUBLE)")
FOREST_CLOSED = ("''", "'not_evaluated'", text(K.FOREST_GATE_REASON), "CAST(NULL AS BIGINT)", "CAST(NULL AS BIGINT)",
                 "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)")


def counts_cte(forest: tuple) -> str:
    name, status, reason, rows, flags, training, contamination = forest
    return f"""method_counts AS (
  SELECT CAST(row_number() OVER (ORDER BY method_order, field_order) AS INT) AS ordinal, * EXCLUDE (method_order, field_order) FROM (
    SELECT b.method, b.field, 'evaluated' AS status, CAST(NULL AS VARCHAR) AS reason, b.evaluated_rows, count(h.row_number) AS flagged_rows,
      CAST(NULL AS BIGINT) AS training_rows, CAST(NULL AS DOUBLE) AS contamination, CASE b.method WHEN 'iqr' THEN 1 ELSE 2 END AS method_order, b.field_order
    FROM bounds b LEFT JOIN evidence h ON b.method = h.method AND b.field = h.field
    GROUP BY b.method, b.field, b.field_order, b.evaluated_rows
    UNION ALL SELECT 'isolation_forest', {name}, {status}, {reason}, {rows}, {flags}, {training}, {contamination}, 3, 1))"""


REVIEW_ORDER = "votes DESC, coalesce(forest_score, 0.0) ASC, row_number"


def reading_case(index: int) -> str:
    def value(reading: tuple) -> str:
        part = reading[index]
        return str(part).lower() if isinstance(part, bool) else text(part)

    return (f"CASE WHEN UnitPrice < 0 THEN {value(K.NEGATIVE_PRICE_READING)} "
            f"WHEN {QTY} < 0 AND starts_with(InvoiceNo, 'C') THEN {value(K.RETURN_READING)} "
            f"WHEN {QTY} < 0 THEN {value(K.NEGATIVE_QUANTITY_READING)} "
            f"WHEN UnitPrice = 0 THEN {value(K.ZERO_PRICE_READING)} "
            f"WHEN votes > 0 THEN {value(K.FLAGGED_READING)} ELSE {value(K.NO_SIGNAL_READING)} END")


READINGS = f"""
readings AS (
  SELECT r.*, s.forest_score, coalesce(f.votes, 0) AS votes, coalesce(f.signals, '') AS signals, coalesce(f.evidence, '') AS evidence,
    {reading_case(0)} AS category, {reading_case(1)} AS business_rule, {reading_case(2)} AS message,
    {reading_case(3)} AS next_step
  FROM retail r LEFT JOIN flagged f USING (row_number) LEFT JOIN forest s USING (row_number))
"""


def anomalies(body: str) -> str:
    return retail(body, bounds_cte(RETAIL_FIELDS, "retail"), values_cte(RETAIL_FIELDS, "retail"),
                  *forest_ctes(RETAIL_FIELDS, "retail"), SIGNALS.strip(), counts_cte(FOREST_EVALUATED), READINGS.strip())


def event_anomalies(body: str) -> str:
    numbered = "numbered AS (SELECT row_number() OVER (ORDER BY event_id) AS row_number, * FROM events)"
    return "WITH " + ", ".join([numbered, bounds_cte(["value"], "numbered"), values_cte(["value"], "numbered"),
                                *NO_FOREST, SIGNALS.strip(), counts_cte(FOREST_CLOSED)]) + "\n" + body


EXPLANATION = f"""
SELECT row_number, CASE WHEN votes > 0 THEN 'flagged' ELSE 'not_flagged' END AS status, votes, signals,
  forest_score, InvoiceNo AS invoice_number, {", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in RETAIL_FIELDS)},
  evidence, category,
  business_rule, next_step, CASE WHEN business_rule THEN message END AS business_context
FROM readings"""

# --- distributions -----------------------------------------------------------------
def histogram(source: str, column: str, extra: str = "", places: int = 4) -> str:
    """24 equal bins over scaled values, each value checked against the edges of its bin."""
    return f"""
data AS (SELECT CAST({column} AS DOUBLE) AS value FROM {source}),
whole AS (SELECT min(value) AS minimum, max(value) AS maximum, count(value) AS n, max(abs(value)) AS scale,
            quantile_cont(value / (SELECT max(abs(value)) FROM data), 0.01) * max(abs(value)) AS q01,
            quantile_cont(value / (SELECT max(abs(value)) FROM data), 0.99) * max(abs(value)) AS q99 FROM data),
kept AS (SELECT value FROM data, whole WHERE {extra or 'value IS NOT NULL'}),
limits AS (SELECT max(abs(value)) AS scale, min(value) / max(abs(value)) AS low, max(value) / max(abs(value)) AS high,
             count(*) AS kept_rows FROM kept),
edges AS (SELECT list_transform(range(0, 25), lambda i: CASE WHEN i = 24 THEN high
            ELSE i * ((high - low) / 24) + low END) AS e, scale, low, high, kept_rows FROM limits),
guessed AS (SELECT value / scale AS s, e,
              CAST(least(floor((value / scale - low) / (high - low) * 24), 23) AS INT) AS g FROM kept, edges),
binned AS (SELECT CASE WHEN s < e[g + 1] THEN g - 1 WHEN g < 23 AND s >= e[g + 2] THEN g + 1 ELSE g END + 1 AS bin
           FROM guessed),
bins AS (SELECT b.bin, round(e[b.bin] * scale, {places}) AS lower_edge, round(e[b.bin + 1] * scale, {places}) AS upper_edge,
           count(x.bin) AS value_count
         FROM range(1, 25) b(bin) CROSS JOIN edges LEFT JOIN binned x ON x.bin = b.bin
         GROUP BY b.bin, e, scale)"""


def buckets(source: str, moment: str, filled: str, ctes: str = "") -> str:
    return f"""WITH {ctes}
moments AS (SELECT {moment} AS moment, {filled} AS filled FROM {source}),
facts AS (SELECT min(moment) AS first, max(moment) AS last, count(moment) AS usable,
            count(*) FILTER (filled) - count(moment) AS invalid,
            CASE WHEN year(max(moment)) - year(min(moment)) > 3 THEN 'year' ELSE 'month' END AS unit FROM moments),
periods AS (SELECT unnest(generate_series(date_trunc(unit, first), date_trunc(unit, last),
              CASE unit WHEN 'year' THEN INTERVAL 1 YEAR ELSE INTERVAL 1 MONTH END)) AS start, unit, usable, invalid
            FROM facts)
SELECT unit AS time_unit, CASE unit WHEN 'year' THEN strftime(start, '%Y') ELSE strftime(start, '%Y-%m') END AS period,
  count(moment) AS value_count, usable AS usable_count, invalid AS invalid_date_count
FROM periods LEFT JOIN moments ON date_trunc(unit, moment) = CAST(start AS TIMESTAMP)
GROUP BY unit, start, usable, invalid"""


def safe_text(expression: str) -> str:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        expression = f"replace({expression}, {text(plain)}, {text(escaped)})"
    return expression


PRINTABLE = "regexp_replace(text, '[\\p{C}\\p{Z}]', ' ', 'g')"
SORTED_LINES = ("numbered AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) "
                "AS row_number, * FROM lineitem)")
FAULT_COLUMNS = "l_orderkey, l_partkey, l_returnflag, l_extendedprice, l_quantity"

ALL_HEADERS = "headers AS (" + union(
    [*[column_facts(t, t) for t in TABLES], column_facts("retail", "(SELECT * EXCLUDE (row_number) FROM retail)")]) + ")"

SQL: dict[str, str] = {
    # sources and catalog
    "scan_typed_csv": "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, "
                      "c_mktsegment FROM customer",
    "scan_spanning_csv": "SELECT doc_id, " + ", ".join(
        f"CASE WHEN {c} NOT IN ({', '.join(map(text, K.MISSING_TEXTS))}) THEN {c} END AS {c}" for c in ("text", "lang", "source")
    ) + ", n_chars FROM documents",
    "ingest_summary": union([
        *[f"SELECT '{name}' AS file_name, count(*) AS rows_count, (SELECT count(*) FROM (DESCRIBE {t})) AS columns_count, "
          f"'{status}' AS status, CAST(NULL AS VARCHAR) AS reason, CAST({dataset} AS BIGINT) AS dataset_id FROM {t}"
          for t, name, status, dataset in (
              ("customer", "customer.csv", "ingested", "NULL"), ("orders", "orders.csv", "ingested", "NULL"),
              ("part", "part.csv", "ingested", "NULL"), ("supplier", "supplier.csv", "ingested", "NULL"),
              ("customer", "again.csv", "reused", "1"))],
        f"SELECT 'negative_orders.csv', count(*), (SELECT count(*) FROM (DESCRIBE orders)), 'rejected', "
        f"{text(K.EMPTY_UPLOAD_REASON)}, NULL FROM orders WHERE o_totalprice < 0",
        f"SELECT 'named.txt', NULL, NULL, 'rejected', {text(K.EXTENSION_REASON)}, NULL",
    ]),
    "table_fingerprint": (lambda cells: f"""
SELECT count(*) AS rows_count, CAST(sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS DECIMAL(38, 0)) AS hash_sum,
  CAST(sum(CAST(('0x' || substr(h, 16, 15)) AS BIGINT)) AS DECIMAL(38, 0)) AS second_hash_sum
FROM (SELECT md5(concat_ws(',', {cells})) AS h FROM orders)""")(", ".join(
        f"coalesce(concat(strlen({v}), ':', {v}), '-')" for v in (
            "CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", "CAST(o_totalprice AS VARCHAR)",
            "CAST(o_orderdate AS VARCHAR)", "o_orderpriority"))),
    "content_fingerprint": catalog("SELECT id, content_length, content_sha FROM catalog"),
    "catalog_valid_paths": catalog("SELECT id, file_path, resolved_path FROM valid"),
    "catalog_latest_distinct": catalog(
        "SELECT id, file_name, content_length FROM valid "
        "QUALIFY row_number() OVER (PARTITION BY content_length, content_sha ORDER BY id DESC) = 1"),
    "catalog_find_duplicate": catalog(
        "SELECT c.id AS upload_id, max(v.id) AS existing_id FROM catalog c LEFT JOIN valid v "
        "ON c.rows_count = v.rows_count AND c.columns_count = v.columns_count "
        "AND c.content_length = v.content_length AND c.content_sha = v.content_sha GROUP BY c.id"),
    "catalog_remove_group": catalog("SELECT id, status FROM marked", CHOSEN),
    "catalog_removal_counts": catalog(
        "SELECT count(*) FILTER (status = 'removed') AS deleted_records, "
        "count(*) FILTER (status = 'kept') AS kept_records FROM marked", CHOSEN),
    "catalog_upsert": """
WITH known AS (SELECT doc_id AS id, source AS file_name, concat('uploads/doc', doc_id + 700, '.csv') AS file_path,
                 n_chars AS rows_count, 5 AS columns_count FROM documents),
sources AS (SELECT concat('uploads/doc', c_custkey, '.csv') AS file_path, c_nationkey AS rows_count, 8 AS columns_count,
              s_name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)
SELECT id, CASE WHEN s.file_path IS NULL THEN file_name
                ELSE coalesce(s_name, regexp_extract(s.file_path, '[^/]+$')) END AS file_name,
  coalesce(k.file_path, s.file_path) AS file_path, CAST(coalesce(s.rows_count, k.rows_count) AS BIGINT) AS rows_count,
  CAST(coalesce(s.columns_count, k.columns_count) AS BIGINT) AS columns_count,
  CASE WHEN s.file_path IS NULL THEN 'kept' WHEN k.file_path IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM known k FULL OUTER JOIN sources s ON k.file_path = s.file_path""",
    "catalog_search": catalog(
        "SELECT id, file_name, quality * 1000000 + l.doc_id AS position FROM catalog LEFT JOIN labels l "
        "ON l.doc_id = id WHERE contains(lower(file_name), 'src1') ORDER BY position ASC NULLS LAST, id DESC"),
    "inject_faults": f"""
WITH {SORTED_LINES}
SELECT row_number, l_orderkey, l_partkey,
  CASE WHEN row_number BETWEEN 1 AND 100 THEN NULL ELSE l_returnflag END AS l_returnflag,
  CASE WHEN row_number BETWEEN 121 AND 160 THEN -l_extendedprice ELSE l_extendedprice END AS l_extendedprice,
  CASE WHEN row_number BETWEEN 201 AND 280 THEN l_quantity + 25 ELSE l_quantity END AS l_quantity
FROM numbered WHERE row_number NOT BETWEEN 351 AND 380
UNION ALL SELECT row_number - 50, {FAULT_COLUMNS} FROM numbered WHERE row_number BETWEEN 401 AND 430""",
    # headers and roles
    "identifier_columns": retail(f"SELECT table_name, column_name, rows_count, {IDENTIFIER} AS is_identifier FROM headers", ALL_HEADERS),
    "schema_roles": retail(roles_of("headers"), ALL_HEADERS),
    "numeric_fields": retail(
        f"SELECT table_name, column_name, filled AS value_count FROM headers WHERE kind IN {NUMBER_KINDS} AND NOT {IDENTIFIER}",
        ALL_HEADERS),
    "logical_types": retail("SELECT ordinal, column_name, logical_type FROM typed", MISSING_ROWS, LOGICAL),
    "date_parse_ratio": "WITH " + ORDER_TEXTS.strip() + "\n" + union(
        f"SELECT {i} AS ordinal, count(*) AS probed_values, "
        f"count(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y %H:%M'), try_strptime(v, '%Y/%m/%d'))) "
        f"AS parsed_values, round(count(coalesce(try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%m/%d/%Y %H:%M'), "
        f"try_strptime(v, '%Y/%m/%d'))) / count(*), 6) AS parse_ratio "
        f"FROM (SELECT {c} AS v FROM order_texts)"
        for i, c in ((2, "iso_day"), (3, "us_minute"), (4, "partly"), (5, "o_orderpriority"))),
    "parse_dates_mixed": "SELECT o_orderkey, CASE WHEN left(o_orderpriority, 1) IN ('1', '2', '3', '4') "
                         "THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS parsed FROM orders",
    # scalars
    "to_numeric_lenient": retail(
        "SELECT row_number, try_cast(Quantity AS DOUBLE) AS quantity, try_cast(InvoiceNo AS DOUBLE) AS invoice, "
        "try_cast(Description AS DOUBLE) AS description FROM retail"),
    "cancellation_flag": retail("SELECT row_number, starts_with(InvoiceNo, 'C') AS cancelled FROM retail"),
    "report_text": (f"SELECT doc_id, {safe_text(PRINTABLE)} AS safe_text, "
                    + safe_text(f"(CASE WHEN length({PRINTABLE}) > 320 THEN concat(left({PRINTABLE}, 317), '...') "
                                f"ELSE {PRINTABLE} END)") + " AS cell_text FROM documents"),
    "report_names": r"""
WITH stems AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(url || '.CSV', '[^/]*$'),
                 '(?i)\.(csv|xlsx)$', ''), '[<>:"/\\|?*]', '_', 'g'), ' .')[:100] AS stem FROM pages)
SELECT page_id, concat('Data Quality Report - ', CASE WHEN stem = '' THEN 'Dataset' ELSE stem END, '.pdf') AS download_name
FROM stems""",
    # profile
    "profile_summary": quality("SELECT n AS rows_count, CAST(13 AS BIGINT) AS columns_count, dups AS duplicate_rows_count, "
                               "missing AS total_missing_values, "
                               "(SELECT count(*) FROM ranked_columns WHERE ranked_columns.missing > 0) "
                               "AS columns_with_missing_values FROM scored"),
    "column_missing": retail("SELECT ordinal, column_name, rows_count, missing_count, missing_percentage "
                             "FROM missing_rows", MISSING_ROWS),
    "column_unique": retail("SELECT ordinal, column_name, unique_count FROM missing_rows", MISSING_ROWS),
    "column_samples": retail(
        "SELECT ordinal, position, value FROM "
        "(SELECT ordinal, row_number() OVER (PARTITION BY ordinal ORDER BY row_number) AS position, value FROM long) "
        "WHERE position <= 5", LONG),
    "numeric_summary": union(numeric_row(i, c, "lineitem") for i, c in enumerate(HEADERS["lineitem"][:8], 1)),
    "date_range": union(
        f"SELECT {i} AS ordinal, '{c}' AS column_name, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS minimum, "
        f"strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS maximum FROM orders WHERE {test}"
        for i, c, test in ((2, "iso_day", "true"), (3, "us_minute", "true"), (4, "partly", "o_orderstatus <> 'P'"))),
    "top_values": retail(
        "SELECT * FROM (SELECT ordinal, value, count(*) AS value_count, "
        "row_number() OVER (PARTITION BY ordinal ORDER BY count(*) DESC, value) AS position "
        "FROM long WHERE ordinal IN (SELECT ordinal FROM typed WHERE logical_type = 'categorical') GROUP BY ordinal, value) "
        "WHERE position <= 5", LONG, MISSING_ROWS, LOGICAL),
    "column_profile": retail("SELECT ordinal, column_name, data_type, logical_type, missing_count, missing_percentage, "
                             "unique_count FROM typed", MISSING_ROWS, LOGICAL),
    # quality
    "completeness": quality(
        "SELECT missing AS missing_values, round(coverage, 2) AS cell_coverage_score, "
        "(SELECT arg_min(column_name, (-missing, ordinal)) FROM ranked_columns) AS worst_column, "
        "round(worst, 2) AS worst_column_missing_percentage, round(penalty, 2) AS concentration_penalty, "
        "completeness AS score, (SELECT reason FROM dimensions WHERE ordinal = 1) AS reason FROM scored"),
    "uniqueness": quality("SELECT dups AS duplicate_rows, uniqueness AS score FROM scored"),
    "duplicate_rows": retail(
        f"SELECT row_number, InvoiceNo, StockCode FROM retail QUALIFY row_number() OVER "
        f"(PARTITION BY {', '.join(RETAIL)} ORDER BY row_number) > 1"),
    "validity": quality(
        "SELECT validity AS score, invalid_rows, bad_quantity AS malformed_quantity, CAST(0 AS BIGINT) AS malformed_price, "
        "negative_quantity, negative_price, zero_price, complete_rows AS complete_input_rows, "
        "round(100.0 * complete_rows / n, 2) AS coverage_percentage, true AS cancellation_rule_evaluated, "
        "(SELECT reason FROM dimensions WHERE ordinal = 3) AS reason FROM scored"),
    "invalid_rows": retail(
        "SELECT row_number, InvoiceNo, Quantity, UnitPrice, concat_ws(', ', "
        "CASE WHEN negative_quantity THEN 'negative_quantity' END, CASE WHEN negative_price THEN 'negative_price' END, "
        "CASE WHEN bad_quantity THEN 'malformed_quantity' END) AS rules_broken FROM checked "
        "WHERE negative_quantity OR negative_price OR bad_quantity", RULES.strip()),
    "product_description": quality("SELECT codes AS codes_checked, bad_codes AS codes_affected FROM scored"),
    "line_total": quality(
        "SELECT 'line_total' AS rule, totals_score AS score, complete_rows AS checked, mismatches AS affected, "
        "round(100.0 * complete_rows / n, 2) AS coverage_percentage, 'Quantity, UnitPrice, LineTotal' AS columns, "
        "false AS discounted_rows_excluded, CAST(NULL AS VARCHAR) AS tax_amount_column FROM scored"),
    "line_total_mismatches": retail(
        "SELECT row_number, qty AS quantity, UnitPrice AS unit_price, LineTotal AS line_total, "
        "round(expected, 4) AS expected_total, round(LineTotal - expected, 4) AS difference FROM checked WHERE mismatch",
        RULES.strip()),
    "consistency": quality(
        "SELECT consistency AS score, codes AS checked_stock_codes, bad_codes AS inconsistent_stock_codes, "
        "(SELECT reason FROM dimensions WHERE ordinal = 4) AS reason FROM scored"),
    "overall_quality": quality(
        f"SELECT (SELECT n FROM counted) AS rows_count, round(0.5 * mean + 0.5 * lowest, 2) AS overall_quality_score, "
        f"{grade('round(0.5 * mean + 0.5 * lowest, 2)')} AS quality_grade, round(mean, 2) AS weighted_mean, "
        f"limiting AS limiting_dimension, lowest AS limiting_dimension_score FROM overall"),
    "quality_dimensions": quality(
        f"SELECT ordinal, dimension, weight, score, CAST(NULL AS VARCHAR) AS status, reason, "
        f"{grade('score')} AS dimension_grade FROM dimensions"),
    "quality_empty": union(
        f"SELECT {i} AS ordinal, '{d}' AS dimension, CAST({K.DIMENSION_WEIGHTS[d]} AS DOUBLE) AS weight, CAST(NULL AS DOUBLE) AS score, "
        f"'not_evaluated' AS status, {text(K.NO_ROWS_REASON)} AS reason, CAST(NULL AS VARCHAR) AS dimension_grade "
        f"FROM orders HAVING count(*) FILTER (o_totalprice < 0) = 0"
        for i, d in enumerate(K.DIMENSIONS, 1)),
    "quality_issues": quality("SELECT * FROM found"),
    "quality_issues_ranked": quality(
        "SELECT * FROM ranked ORDER BY severity_rank, affected_records DESC, ordinal"),
    # anomalies
    "anomaly_bounds": anomalies(
        "SELECT method, field, 'evaluated' AS status, CAST(NULL AS VARCHAR) AS reason, evaluated_rows, "
        "round(lower_bound, 4) AS lower_bound, round(upper_bound, 4) AS upper_bound FROM bounds"),
    "anomaly_method_counts": anomalies("SELECT * FROM method_counts"),
    "anomaly_event_counts": event_anomalies("SELECT * FROM method_counts"),
    "anomaly_method_status": anomalies("SELECT method, max(status) AS status FROM method_counts GROUP BY method"),
    "anomaly_summary": anomalies(
        f"SELECT 'evaluated' AS status, (SELECT count(*) FROM retail) AS rows_count, count(*) AS anomaly_rows_count, "
        f"{text(K.ANOMALY_MESSAGE)} AS message FROM flagged"),
    "forest_gate": retail(
        f"SELECT '{', '.join(RETAIL_FIELDS)}' AS fields, count(*) AS complete_rows, true AS is_open FROM retail "
        f"WHERE {' AND '.join(f + ' IS NOT NULL' for f in RETAIL_FIELDS)}"),
    "forest_sample": retail(
        f"SELECT row_number, row_number() OVER (ORDER BY md5(concat(CAST(row_number AS VARCHAR), '-{K.SEED}'))) - 1 AS rank FROM retail "
        f"QUALIFY rank < {TREES * TREE_ROWS}"),
    "forest_model": retail(
        "SELECT CAST(tree AS INT) AS tree, CAST(node AS INT) AS node, CAST(coalesce(feature, -1) AS INT) AS feature, "
        "round(coalesce(threshold, 0.0), 6) AS threshold, round(path, 6) AS path FROM model", *forest_ctes(RETAIL_FIELDS, "retail")),
    "forest_scores": retail(
        "SELECT r.row_number, forest_score FROM retail r LEFT JOIN forest USING (row_number)",
        *forest_ctes(RETAIL_FIELDS, "retail")),
    "forest_method_counts": anomalies("SELECT * FROM method_counts WHERE method = 'isolation_forest'"),
    "forest_queue_page": anomalies(
        f"SELECT row_number, votes, forest_score FROM flagged ORDER BY {REVIEW_ORDER} LIMIT 20"),
    "anomaly_votes": anomalies("SELECT row_number, votes, signals FROM readings"),
    "anomaly_queue": anomalies(f"SELECT row_number, votes, signals FROM flagged ORDER BY {REVIEW_ORDER}"),
    "anomaly_page": anomalies(
        "SELECT row_number, votes, (SELECT CAST(CASE WHEN count(*) > 40 THEN 40 END AS BIGINT) FROM flagged) AS next_offset "
        f"FROM flagged ORDER BY {REVIEW_ORDER} LIMIT 20 OFFSET 20"),
    "anomaly_retail_context": anomalies(
        f"SELECT count(*) FILTER ({QTY} < 0 AND starts_with(InvoiceNo, 'C')) AS flagged_negative_quantity_with_cancellation, "
        f"count(*) FILTER ({QTY} < 0 AND NOT starts_with(InvoiceNo, 'C')) "
        f"AS flagged_negative_quantity_without_cancellation FROM readings WHERE votes > 0"),
    "anomaly_evidence": anomalies(
        "SELECT row_number, position, method, field, value AS observed_value, direction, round(boundary, 4) AS boundary, "
        "round(round(abs(value - boundary), 6), 4) AS distance_from_boundary, message FROM evidence"),
    "row_interpretation": anomalies("SELECT row_number, category, business_rule, message, next_step FROM readings"),
    "row_explanation": anomalies(EXPLANATION),
    "row_lookup": anomalies(EXPLANATION + " WHERE row_number = 17"),
    # distributions
    "numeric_usability": retail(union(
        f"SELECT '{c}' AS column_name, count(*) AS rows_count, count(*) - count({c}) AS missing_count, "
        f"count(*) FILTER (isfinite(CAST({c} AS DOUBLE))) AS usable_count, "
        f"count(*) FILTER (isinf(CAST({c} AS DOUBLE))) AS excluded_nonfinite_count FROM retail"
        for c in ("UnitPrice", "CustomerID", "LineNumber", "SuppKey", "OrderKey", "PartKey", "LineTotal"))),
    "discrete_counts": "SELECT l_discount AS value, count(*) AS value_count, CASE WHEN l_discount = 0 THEN '0' "
                       "ELSE CAST(l_discount AS VARCHAR) END AS label FROM lineitem GROUP BY l_discount ORDER BY value",
    "histogram_full": "WITH" + histogram("lineitem", "l_extendedprice") + "\nSELECT * FROM bins",
    "histogram_events": "WITH" + histogram("events", "value", places=6) + "\nSELECT * FROM bins",
    "histogram_constant": "SELECT CAST(1 AS BIGINT) AS bin, CAST(0 AS DOUBLE) AS lower_edge, CAST(0.5 AS DOUBLE) AS upper_edge, count(*) AS value_count "
                          "FROM documents WHERE n_chars - length(text) = 0",
    "histogram_central": "WITH" + histogram("events", "value", extra="value BETWEEN q01 AND q99", places=6) +
                         "\nSELECT bins.*, n - kept_rows AS outside_central_count, minimum, maximum FROM bins, whole, limits",
    "time_buckets": buckets("lineitem", "l_shipdate", "l_shipdate IS NOT NULL"),
    "time_buckets_text": buckets("order_texts", "try_strptime(partly, '%Y/%m/%d')", "partly IS NOT NULL",
                                 ORDER_TEXTS.strip() + ","),
    "time_buckets_month": buckets("events", "ts", "ts IS NOT NULL"),
    "category_top_other": """
WITH counts AS (SELECT p_brand AS value, count(*) AS value_count,
                  row_number() OVER (ORDER BY count(*) DESC, p_brand) AS position FROM part GROUP BY p_brand)
SELECT position, value, value_count FROM counts WHERE position <= 12
UNION ALL SELECT 0, 'Other', CAST(sum(value_count) AS BIGINT) FROM counts WHERE position > 12 HAVING count(*) > 0""",
    "category_share": "SELECT o_orderpriority AS value, count(*) AS value_count, "
                      "round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM orders GROUP BY 1",
    "distribution_status": retail(
        "SELECT column_name, logical_type, rows_count - missing_count AS usable_count, "
        "CASE WHEN logical_type IN ('identifier', 'text') THEN 'not_evaluated' ELSE 'evaluated' END AS status, "
        f"CASE WHEN logical_type IN ('identifier', 'text') THEN {text(K.NOT_SUMMARIZED_REASON)} END AS reason FROM typed",
        MISSING_ROWS, LOGICAL),
    "missing_ranking": retail(
        f"SELECT column_name, missing_count, missing_percentage, {severity('missing_percentage')} AS band "
        "FROM missing_rows WHERE missing_count > 0 ORDER BY missing_count DESC, ordinal", MISSING_ROWS),
    "signal_ranking": anomalies(
        "SELECT method, field, flagged_rows FROM method_counts WHERE flagged_rows > 0 "
        "ORDER BY flagged_rows DESC, ordinal"),
    # report
    "report_headline": retail(
        "SELECT concat(printf('%.2f', round(0.5 * mean + 0.5 * lowest, 2)), ' / 100') AS score, "
        f"concat({initcap(grade('round(0.5 * mean + 0.5 * lowest, 2)'))}, ' by configured checks') AS grade, "
        "format('{:,}', n) AS rows, '13' AS columns, format('{:,}', missing) AS missing_cells, "
        "format('{:,}', dups) AS duplicate_rows, (SELECT format('{:,}', count(*)) FROM flagged) AS flagged_rows, "
        "round(mean, 2) AS weighted_mean, limiting AS limiting_dimension, lowest AS limiting_dimension_score, "
        "(SELECT count(*) FROM found WHERE severity = 'high') AS high_findings, "
        "(SELECT arg_min(message, ordinal) FROM found WHERE severity = 'high') AS first_high_finding "
        "FROM scored, overall",
        FACTS.strip(), bounds_cte(RETAIL_FIELDS, "retail"), values_cte(RETAIL_FIELDS, "retail"),
        *forest_ctes(RETAIL_FIELDS, "retail"), SIGNALS.strip()),
    "report_dimensions": quality(
        f"SELECT ordinal, {initcap('dimension')} AS dimension, concat(CAST(round(weight * 100) AS INT), '%') AS weight, "
        "concat(printf('%.2f', score), ' / 100') AS score, coalesce(reason, 'Evaluated') AS reason FROM dimensions"),
    "report_findings": quality(
        f"SELECT position, {initcap('severity')} AS severity, concat_ws(' / ', {initcap('dimension')}, column_name) AS area, "
        "format('{:,}', affected_records) AS affected, message AS evidence FROM (SELECT *, row_number() OVER "
        "(ORDER BY severity_rank, affected_records DESC, ordinal) AS position FROM ranked)"),
    "report_columns": retail(
        f"SELECT ordinal, column_name, {initcap('logical_type')} AS type, concat(format('{{:,}}', missing_count), ' (', "
        "printf('%.2f', missing_percentage), '%)') AS missing, format('{:,}', unique_count) AS \"unique\" "
        "FROM typed", MISSING_ROWS, LOGICAL),
    "report_methods": anomalies(
        f"SELECT ordinal, CASE method WHEN 'iqr' THEN 'IQR' WHEN 'z_score' THEN 'Z-score' ELSE {text(K.METHOD_LABELS['isolation_forest'])} END "
        "AS method, field AS fields, format('{:,}', flagged_rows) AS flags, 'Evaluated' AS reason FROM method_counts"),
    "report_notes": quality(union([
        "SELECT 1 AS ordinal, 'Retail field matches: transaction id: InvoiceNo; quantity: Quantity; unit price: UnitPrice; "
        "product id: StockCode; product name: Description; line total: LineTotal. "
        "Ambiguous names are excluded from retail rules.' AS note",
        "SELECT 2, concat('Retail validity had complete quantity and price inputs for ', format('{:,}', complete_rows), "
        "' rows (', printf('%.2f', round(100.0 * complete_rows / n, 2)), '% of the dataset). "
        "Missing inputs are covered by completeness.') FROM scored",
        "SELECT 3, concat('Retail consistency comparisons: product description: ', format('{:,}', codes), ' checked, ', "
        "format('{:,}', bad_codes), ' inconsistent; line total: ', format('{:,}', complete_rows), ' checked, ', "
        "format('{:,}', mismatches), ' inconsistent, ', printf('%.2f', round(100.0 * complete_rows / n, 2)), "
        "'% of rows compared.') FROM scored",
        "SELECT 4, concat('Completeness starts from ', printf('%.2f', round(coverage, 2)), ' / 100 filled-cell coverage. ', "
        "(SELECT arg_min(column_name, (-missing, ordinal)) FROM ranked_columns), ' is missing in ', "
        "printf('%.2f', round(worst, 2)), '% of rows, so concentrated missingness deducts ', "
        "printf('%.2f', round(penalty, 2)), ' points from the completeness dimension (maximum 15).') FROM scored",
    ])),
    "report_examples": anomalies(
        f"SELECT row_number, {initcap('category')} AS category, message, evidence, next_step FROM readings "
        f"WHERE votes > 0 ORDER BY {REVIEW_ORDER} LIMIT 5"),
}

SQL.update(ledger.SQL)

# The columns of each part of the report by name, and the query that has its rows.
REPORT_PARTS = {
    "headline": ("report_headline", "columns duplicate_rows first_high_finding flagged_rows grade high_findings limiting_dimension "
                 "limiting_dimension_score missing_cells rows score weighted_mean"),
    "dimensions": ("report_dimensions", "dimension ordinal reason score weight"),
    "notes": ("report_notes", "note ordinal"),
    "findings": ("report_findings", "affected area evidence position severity"),
    "columns": ("report_columns", "column_name missing ordinal type unique"),
    "methods": ("report_methods", "fields flags method ordinal reason"),
    "examples": ("report_examples", "category evidence message next_step row_number"),
    "retail_context": ("anomaly_retail_context", "flagged_negative_quantity_with_cancellation flagged_negative_quantity_without_cancellation"),
}


def report_part(name: str, key: str, columns: str) -> str:
    cells = ", ".join(f"""coalesce(CAST("{c}" AS VARCHAR), '-')""" for c in columns.split())
    return f"SELECT '{name}' AS part, concat_ws(' | ', {cells}) AS content FROM ({SQL[key]})"


SQL["report_all"] = union(report_part(name, key, columns) for name, (key, columns) in REPORT_PARTS.items())
