"""DuckDB's SQL for the three passes of entity resolution: each key's rows are folded one after the other by recursion."""

from __future__ import annotations

from ..operators.resolve import MOST_NOTICES, SUPPLIER_DAYS, TITLE_DAYS, VALUE_RATIO

#: Every notice with its slug and no canonical id yet.
ALL = """SELECT *, trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '-') AS title_slug, CAST(NULL AS BIGINT) AS canonical FROM n"""


def window(end: str) -> str:
    return f"{ALL} WHERE ingested_at < TIMESTAMP '{end}' AND ingested_at >= TIMESTAMP '{end}' - INTERVAL 30 DAY"


def first_pass(rows: str) -> str:
    """(notice_id, source, canonical, pass_key) of groups by procurer and category over a table with `canonical`."""
    return f"""SELECT notice_id, source, canonical, procurer_ico || '|' || cpv_code AS pass_key FROM (SELECT notice_id, source, procurer_ico, cpv_code,
    first_value(notice_id) OVER (PARTITION BY procurer_ico, cpv_code ORDER BY publication_date NULLS LAST, notice_id) AS canonical FROM {rows}
    JOIN (SELECT procurer_ico, cpv_code FROM {rows} WHERE procurer_ico <> '' AND cpv_code <> '' GROUP BY 1, 2
      HAVING count(DISTINCT source) > 1 AND count(*) > count(canonical)) g USING (procurer_ico, cpv_code))"""


def _fold(rows: str, days: int) -> str:
    """Clusters of more than one row of (key, id, day, source, vals): an entry joins the first cluster whose anchor has
    another source and lies within the days, and with whose every member its values agree."""
    agrees = f"len(list_filter(m, lambda x: len(list_filter(r.vals, lambda y: x > 0 AND y > 0 AND greatest(x, y) <= {VALUE_RATIO} * least(x, y))) > 0)) > 0"
    fits = f"c.source <> r.source AND r.day - c.day <= {days} AND (r.vals IS NULL OR len(list_filter(c.vals, lambda m: NOT ({agrees}))) = 0)"
    opened = "{'id': id, 'day': day, 'source': source, 'vals': [vals]}"
    joined = "CASE WHEN c.id = hit THEN {'id': c.id, 'day': c.day, 'source': c.source, 'vals': list_append(c.vals, vals)} ELSE c END"
    return f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day, id) AS rn FROM ({rows})),
    f AS (SELECT key, rn, id, source, id AS canonical, [{opened}] AS clusters FROM r WHERE rn = 1
      UNION ALL SELECT key, rn, id, source, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(clusters, {opened}) ELSE list_transform(clusters, lambda c: {joined}) END
      FROM (SELECT r.*, clusters, list_filter(clusters, lambda c: {fits})[1].id AS hit FROM f JOIN r ON r.key = f.key AND r.rn = f.rn + 1))
    SELECT id AS notice_id, source, canonical, key AS pass_key FROM f QUALIFY count(*) OVER (PARTITION BY key, canonical) > 1"""


def second_pass(rows: str) -> str:
    return _fold(
        f"""SELECT title_slug AS key, notice_id AS id, publication_date AS day, source, CAST(NULL AS DOUBLE[]) AS vals FROM {rows}
    WHERE canonical IS NULL AND coalesce(procurer_ico, '') = '' AND title_slug <> '' AND publication_date IS NOT NULL""",
        TITLE_DAYS,
    )


def suppliers(rows: str) -> str:
    """(supplier_ico, notice_id) of unassigned notices."""
    return f"SELECT DISTINCT supplier_ico, notice_id FROM a JOIN {rows} USING (notice_id) WHERE canonical IS NULL AND supplier_ico <> ''"


def third_pass(rows: str) -> str:
    return _fold(
        f"""SELECT supplier_ico AS key, notice_id AS id, publication_date AS day, source, vals FROM ({suppliers(rows)}) k JOIN {rows} USING (notice_id)
    JOIN (SELECT notice_id, list(award_value) FILTER (award_value IS NOT NULL) AS vals FROM a GROUP BY 1) p USING (notice_id)
    WHERE publication_date IS NOT NULL AND supplier_ico IN (SELECT supplier_ico FROM ({suppliers(rows)}) GROUP BY 1 HAVING count(*) <= {MOST_NOTICES})""",
        SUPPLIER_DAYS,
    )


def stamped(rows: str, assigned: str) -> str:
    """The rows with canonical ids put in; of several groups the one of the largest key wins."""
    return f"""SELECT {rows}.* REPLACE (coalesce(g.c, canonical) AS canonical) FROM {rows}
    LEFT JOIN (SELECT notice_id AS id, arg_max(canonical, pass_key) AS c FROM {assigned} GROUP BY 1) g ON g.id = notice_id"""
