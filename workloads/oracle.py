"""DuckDB SQL whose results the Spark queries must equal."""

from __future__ import annotations

_LIST_ID = "concat('lineitem_', CAST(year(l_shipdate) AS VARCHAR))"

_DIRTY_AFTER = """
    SELECT {list_id} AS list_id, l_orderkey, l_partkey, ROW_NUMBER() OVER () + 1 AS row_no,
           CASE WHEN k % 101 = 0 THEN NULL ELSE l_linestatus END AS linestatus,
           CASE WHEN k % 103 = 0 THEN NULL WHEN k % 97 = 0 THEN 'not_a_number'
                ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS qty_raw, l_linestatus, l_quantity
    FROM (SELECT *, CASE WHEN year(l_shipdate) > {clean_until} THEN l_orderkey ELSE 1 END AS k FROM lineitem)"""


def _dirty(clean_until: int = 0) -> str:
    return _DIRTY_AFTER.format(list_id=_LIST_ID, clean_until=clean_until)


_DIRTY = _dirty()

_ISSUES_OF = """
    SELECT list_id, 'cell' AS level, 'error' AS severity, 'missing_value' AS rule, 'linestatus' AS column_name,
           row_no, CAST(NULL AS VARCHAR) AS bad_value, 0 AS place
    FROM ({rows}) WHERE linestatus IS NULL
    UNION ALL
    SELECT list_id, 'cell', 'error', 'wrong_type', 'qty_raw', row_no, qty_raw, 1
    FROM ({rows}) WHERE qty_raw IS NOT NULL AND TRY_CAST(qty_raw AS DOUBLE) IS NULL"""

_ISSUES = _ISSUES_OF.format(rows=_DIRTY)

_SUM = "SELECT l_partkey, l_linestatus, SUM(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2"
_PRICE = """SELECT l_partkey, l_linestatus, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
            AS l_extendedprice FROM lineitem GROUP BY 1, 2"""
_WARNINGS = f"(SELECT COUNT(DISTINCT {_LIST_ID}) FROM lineitem WHERE year(l_shipdate) <= 1996)"


def _mean(column: str) -> str:
    """The exact mean; AVG over doubles depends on the order of summation."""
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE) / COUNT({column})"


ORACLE: dict[str, str] = {
    "consolidate_sum": _SUM,
    "consolidate_mean": f"SELECT l_partkey, l_linestatus, {_mean('l_quantity')} AS l_quantity FROM lineitem GROUP BY 1, 2",
    "consolidate_multi": f"""SELECT l_suppkey, l_returnflag, SUM(l_quantity) AS l_quantity,
        {_mean('l_discount')} AS l_discount, COUNT(l_extendedprice) AS l_extendedprice
        FROM lineitem GROUP BY 1, 2""",
    "count_over_key": "SELECT l_partkey, COUNT(l_linestatus) AS l_linestatus FROM lineitem GROUP BY l_partkey, lineitem.l_linestatus",
    "merge_tables": """SELECT key, source, CAST(SUM(CAST(amount AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM (
        SELECT l_suppkey AS key, 'lineitem' AS source, l_quantity AS amount FROM lineitem
        UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier) GROUP BY 1, 2""",
    "null_keys": f"SELECT l_partkey, linestatus, COUNT(*) AS n FROM ({_DIRTY}) GROUP BY 1, 2",
    "sum_all_missing": f"""SELECT l_orderkey, COALESCE(SUM(TRY_CAST(qty_raw AS DOUBLE)), 0.0) AS qty,
        COUNT(TRY_CAST(qty_raw AS DOUBLE)) AS n FROM ({_DIRTY}) GROUP BY 1""",
    "ordered_result": f"""SELECT *, ROW_NUMBER() OVER (ORDER BY l_linestatus NULLS LAST, l_partkey NULLS LAST) AS ordinal
        FROM ({_SUM})""",
    "sum_reconciliation": f"""WITH b AS (SELECT SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, COUNT(*) AS n FROM lineitem),
        a AS (SELECT SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, COUNT(*) AS n FROM ({_PRICE}))
        SELECT 'l_extendedprice' AS column_name, CAST(b.s AS DOUBLE) AS sum_before, CAST(a.s AS DOUBLE) AS sum_after,
        b.s = a.s AS passed, b.n AS rows_in, a.n AS rows_out, b.n - a.n AS duplicates_merged FROM a, b""",
    "residual_duplicates": "SELECT l_partkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1",
    "no_residual_duplicates": f"""SELECT l_partkey, l_linestatus, COUNT(*) AS n FROM ({_SUM})
        GROUP BY 1, 2 HAVING COUNT(*) > 1""",
    "range_violations": """SELECT c_nationkey, c_mktsegment,
        CASE WHEN v < 20000 THEN 'below_min' ELSE 'above_max' END AS rule, 'c_acctbal' AS column_name,
        CAST(v AS DOUBLE) AS bad_value
        FROM (SELECT c_nationkey, c_mktsegment, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer GROUP BY 1, 2)
        WHERE v < 20000 OR v > 90000""",
    "result_findings": """WITH m AS (SELECT c_nationkey AS k, c_mktsegment AS s, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS v
            FROM customer GROUP BY 1, 2),
        d AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE k = 1),
        n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY k NULLS LAST, s NULLS LAST) + 1 AS row_no FROM d)
        SELECT 'result' AS level, 'error' AS severity, 'residual_duplicate' AS rule, CAST(NULL AS VARCHAR) AS column_name,
            CAST(NULL AS BIGINT) AS row_no, concat('{"c_nationkey":', k, ',"c_mktsegment":"', s, '"}') AS bad_value
        FROM m WHERE k = 1
        UNION ALL SELECT 'result', 'error', 'sum_mismatch', 'c_acctbal', NULL,
            concat((SELECT SUM(v) FROM m), ' <> ', (SELECT SUM(v) FROM d))
        UNION ALL SELECT 'result', 'error', CASE WHEN v < 20000 THEN 'below_min' ELSE 'above_max' END, 'c_acctbal',
            row_no, CAST(v AS VARCHAR) FROM n WHERE v < 20000 OR v > 90000""",
    "null_violations": f"""SELECT list_id, column_name, COUNT(*) AS n FROM ({_ISSUES})
        WHERE rule = 'missing_value' GROUP BY 1, 2""",
    "type_violations": f"""SELECT list_id, column_name, bad_value, COUNT(*) AS n FROM ({_ISSUES})
        WHERE rule = 'wrong_type' GROUP BY 1, 2, 3""",
    "issue_rows": f"SELECT * EXCLUDE (place) FROM ({_ISSUES})",
    "list_status": f"""WITH l AS (SELECT {_LIST_ID} AS list_id, COUNT(*) AS n, MIN(year(l_shipdate)) AS y FROM lineitem GROUP BY 1),
        e AS (SELECT list_id, COUNT(*) AS errors FROM ({_ISSUES_OF.format(rows=_dirty(1997))}) GROUP BY 1)
        SELECT l.list_id, CASE WHEN COALESCE(errors, 0) = 0 THEN n END AS rows, COALESCE(errors, 0) AS errors,
        CAST(CASE WHEN y <= 1996 THEN 1 ELSE 0 END AS BIGINT) AS warnings,
        CASE WHEN COALESCE(errors, 0) > 0 THEN 'error' WHEN y <= 1996 THEN 'warning' ELSE 'ok' END AS status
        FROM l LEFT JOIN e USING (list_id)""",
    "first_issues": f"""SELECT list_id, arg_min(concat('column ''', column_name, ''', row ', row_no, ': ',
        replace(rule, '_', ' '), CASE WHEN bad_value IS NULL THEN '' ELSE concat(' ''', bad_value, '''') END),
        row_no * 2 + place) AS first_issue, COUNT(*) - 1 AS more FROM ({_ISSUES}) GROUP BY 1""",
    "run_summary": f"""SELECT (SELECT COUNT(*) FROM ({_ISSUES})) AS errors, {_WARNINGS} AS warnings, 'error' AS status,
        (SELECT COUNT(DISTINCT {_LIST_ID}) FROM lineitem) AS lists_found, (SELECT COUNT(*) FROM lineitem) AS rows_in""",
    "strict_gate": f"SELECT * FROM ({_SUM}) WHERE {_WARNINGS} = 0",
    "open_gate": _SUM,
    "blocked_gate": f"SELECT * FROM ({_SUM}) WHERE (SELECT COUNT(*) FROM ({_ISSUES})) = 0",
    "date_coercion": f"""SELECT {_LIST_ID} AS list_id, CAST(CAST(MIN(l_shipdate) AS DATE) AS VARCHAR) AS first_day,
        CAST(CAST(MAX(l_shipdate) AS DATE) AS VARCHAR) AS last_day,
        CAST(SUM(CASE WHEN l_orderkey % 2 <> 0 AND l_linenumber = 2 THEN 0 ELSE l_linenumber END) AS BIGINT) AS lines,
        COUNT(CASE WHEN l_orderkey % 2 <> 0 AND l_linenumber = 2 THEN 1 END) AS bad_lines FROM lineitem GROUP BY 1""",
    "csv_roundtrip": _SUM,
    "decimal_comma": _PRICE,
    "column_conformance": """WITH y AS (SELECT year(l_shipdate) AS y, COUNT(*) AS n FROM lineitem GROUP BY 1)
        SELECT 'column' AS level, 'warning' AS severity, 'unknown_column' AS rule, 'note' AS column_name, n AS records
        FROM y WHERE y = 1995
        UNION ALL SELECT 'column', 'error', 'missing_column', 'l_quantity', n FROM y WHERE y = 1996
        UNION ALL SELECT 'load', 'error', 'duplicate_column', NULL, 0 FROM y WHERE y = 1997""",
    "csv_defects": """SELECT 'encoding' AS rule, COUNT(*) AS records FROM lineitem
        WHERE year(l_shipdate) = 1995 AND l_orderkey % 5 = 0
        UNION ALL SELECT 'malformed_record', COUNT(*) FROM lineitem WHERE year(l_shipdate) = 1996 AND l_orderkey % 7 = 0
        UNION ALL SELECT DISTINCT 'single_column', 0 FROM lineitem WHERE year(l_shipdate) = 1997
        UNION ALL SELECT 'empty_file', 0""",
    "gated_run": _SUM,
    "gated_run_report": """SELECT 'error' AS status, FALSE AS published, COUNT(*) AS errors, TRUE AS nothing_merged,
        COUNT(*) AS cell_issues, COUNT(*) AS places FROM lineitem WHERE l_orderkey % 97 = 0""",
    "quoted_line_breaks": """SELECT l_partkey, CASE WHEN l_orderkey % 7 = 0
            THEN concat(l_linestatus, chr(10), '"', l_returnflag, chr(10), chr(10), ';') ELSE l_linestatus END AS note,
        SUM(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2""",
    "sums_of_any_size": """SELECT l_partkey, kind, SUM(l_quantity) * CASE kind WHEN 'huge' THEN pow(2::DOUBLE, 70)
        ELSE pow(2::DOUBLE, -100) END AS amount, TRUE AS agreed
        FROM lineitem, (VALUES ('cancel'), ('huge'), ('tiny')) AS k(kind) GROUP BY 1, 2""",
    "totals_beyond_1e20": f"""WITH s AS (SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(20,2)) * CAST(10000000000000000 AS DECIMAL(17,0))
            + CAST(0.01 AS DECIMAL(2,2))) AS VARCHAR) AS total, COUNT(*) AS n FROM lineitem)
        SELECT 'l_extendedprice' AS column_name, total AS sum_before, total AS sum_after, TRUE AS passed, n AS rows_in,
        g AS rows_out, n - g AS duplicates_merged FROM s, (SELECT COUNT(*) AS g FROM ({_SUM}))""",
    "validated_tables": f"""WITH d AS (SELECT *, CAST(right(list_id, 4) AS INT) AS y FROM ({_DIRTY})),
        g AS (SELECT SUM(CASE WHEN y = 1996 THEN l_quantity WHEN y = 1997 AND linestatus IS NOT NULL THEN TRY_CAST(qty_raw AS DOUBLE) END)
            AS good_total FROM d)
        SELECT f.*, good_total FROM (
            SELECT 'dirty' AS list_id, 'missing_value' AS rule, 'linestatus' AS column_name, COUNT(*) AS n FROM d
                WHERE y < 1996 AND linestatus IS NULL HAVING COUNT(*) > 0
            UNION ALL SELECT 'dirty', 'wrong_type', 'qty_raw', COUNT(*) FROM d WHERE y < 1996 AND qty_raw = 'not_a_number'
                HAVING COUNT(*) > 0
            UNION ALL SELECT 'lacking', 'missing_column', 'qty_raw', 1
            UNION ALL SELECT 'noted', 'unknown_column', 'l_shipdate', 1) AS f, g""",
    "republish": _SUM,
    "partitioned_run": _SUM,
    "many_headers": _SUM,
    "wide_records": """SELECT CASE WHEN year(l_shipdate) = 1996 THEN 'malformed_record' END AS rule, COUNT(*) AS records,
        COUNT(CASE WHEN year(l_shipdate) = 1996 AND l_orderkey % 500 = 0 THEN 1 END) AS broken FROM lineitem GROUP BY 1""",
    "mixed_formats": _SUM,
    "split_row_numbers": f"""WITH r AS (SELECT * EXCLUDE (list_id, row_no), concat(list_id, '.csv') AS list_id,
            ROW_NUMBER() OVER (PARTITION BY list_id ORDER BY l_orderkey, l_partkey, l_linestatus, l_quantity) + 1 AS row_no
            FROM ({_DIRTY}))
        SELECT list_id, rule, column_name, row_no, bad_value FROM ({_ISSUES_OF.format(rows="SELECT * FROM r")})""",
    "name_forms": "SELECT l_linestatus, SUM(l_quantity) AS total FROM lineitem GROUP BY 1",
    "bounds_on_counts": """SELECT c_nationkey, 'below_min' AS rule, 'c_acctbal' AS column_name, CAST(v AS DOUBLE) AS bad_value
        FROM (SELECT c_nationkey, SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer GROUP BY 1) WHERE v < 100000""",
    "run_modes": f"""WITH n AS (SELECT COUNT(*) AS rows_in, (SELECT COUNT(*) FROM ({_SUM})) AS rows_out FROM lineitem)
        SELECT 'open' AS mode, 'success_with_warnings' AS status, TRUE AS published, 0::BIGINT AS errors, 1::BIGINT AS warnings, rows_in,
            rows_out, TRUE AS sums_agree, TRUE AS written FROM n
        UNION ALL SELECT 'strict', 'error', FALSE, 1, 0, NULL, NULL, NULL, FALSE
        UNION ALL SELECT 'dry', 'success_with_warnings', FALSE, 0, 1, rows_in, rows_out, TRUE, FALSE FROM n
        UNION ALL SELECT 'lacking', 'error', FALSE, 1, 0, NULL, NULL, NULL, FALSE""",
}
