"""Fixture views as DuckDB CTEs, by the same rules as ``folioscope.sources.fixtures``."""

WS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

CTE = {
    "v_lines": "SELECT doc_id, line_no, text FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "v_geo": """SELECT doc_id, line_no, text, 50 + 250 * (line_no % 2) * (doc_id % 2) + (line_no * 7) % 11 AS x0, 90 + 14 * (line_no // (1 + doc_id % 2)) AS y0,
      50 + 250 * (line_no % 2) * (doc_id % 2) + (line_no * 7) % 11 + least(240, 5 * length(text)) AS x1,
      90 + 14 * (line_no // (1 + doc_id % 2)) + 10 + CASE WHEN line_no % 14 = 1 THEN 60 ELSE 0 END AS y1,
      CASE WHEN line_no % 17 = 0 THEN 14 ELSE 10 END AS size, line_no % 17 = 0 AS bold FROM v_lines""",
    "v_boxes": """SELECT doc_id, 'table' AS kind, 0 AS box_no, 40 AS x0, 118 AS y0, 560 AS x1, 160 AS y1 FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, 'table', 1, 50, 125, 550, 153 FROM documents WHERE doc_id % 6 = 0
      UNION ALL SELECT doc_id, 'figure', 0, 40, 174, 560, 216 FROM documents WHERE doc_id % 5 = 0""",
    "v_raw": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '[non-text]' || chr(10) WHEN 1 THEN 'Loose words first' || chr(10) ELSE '' END ||
      string_agg('<|det|>' || list_extract(['text','title','image','table','page_number','display-formula','figure'], (line_no % 7 + 1)::INT) || ' [' || x0 || ', ' || y0 || ', ' ||
        (CASE WHEN line_no % 19 = 0 THEN 2000 WHEN line_no % 13 = 0 THEN x0 - 5 ELSE x1 + 1 END) || ', ' || y1 || ']<|/det|>' || text, chr(10) ORDER BY line_no) ||
      CASE doc_id % 11 WHEN 0 THEN chr(10) || '<|det|>text [1, 2, 3' WHEN 1 THEN chr(10) || chr(10) || 'Loose words last' ELSE '' END AS raw FROM v_geo GROUP BY doc_id""",
    "v_dirty": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN (doc_id % 9 + 1) || '. SCOPE AND TERMS' || chr(10) ELSE '' END ||
      CASE WHEN doc_id % 10 = 0 THEN replace(text, 's', chr(61555)) WHEN doc_id % 20 = 7 THEN replace(text, 'e', chr(65533)) ELSE text END ||
      CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'Figure ' || (doc_id % 7 + 1) || ': a drawing' ELSE '' END AS text FROM documents""",
    "v_scan": """SELECT user_id AS session_id, event_id % 5 AS page_num, event_id, ts, CASE event_type WHEN 'signup' THEN 'page_start' WHEN 'click' THEN 'token' WHEN 'view' THEN 'det_result'
      WHEN 'purchase' THEN 'page_done' ELSE event_type END AS event, value FROM events""",
    "v_scores": "SELECT vec_id AS row_id, embedding AS scores FROM embeddings",
    "v_cells": "SELECT l_orderkey AS page, l_linenumber AS row_no, l_partkey AS part, l_suppkey AS supp, l_quantity AS value FROM lineitem",
    # Records: pieces after each opening tag that have a closing tag; bare text before the first and after blank lines.
    "v_parts": """SELECT doc_id, k, piece FROM (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS piece FROM (SELECT doc_id, string_split(raw, '<|det|>') AS l FROM v_raw))""",
    "v_records": f"""SELECT doc_id, k, 0 AS part, split_part(piece, '<|/det|>', 1) AS meta,
        regexp_replace(split_part(regexp_replace(substr(piece, strpos(piece, '<|/det|>') + 8), '[{WS}]+\\z', ''), chr(10) || chr(10), 1), '[{WS}]+\\z', '') AS content FROM v_parts WHERE k > 0 AND strpos(piece, '<|/det|>') > 0
      UNION ALL SELECT doc_id, k, 1, NULL, substr(c, strpos(c, chr(10) || chr(10)) + 2) FROM (SELECT doc_id, k, regexp_replace(substr(piece, strpos(piece, '<|/det|>') + 8), '[{WS}]+\\z', '') AS c
        FROM v_parts WHERE k > 0 AND strpos(piece, '<|/det|>') > 0) WHERE strpos(c, chr(10) || chr(10)) > 0
      UNION ALL SELECT doc_id, 0, 1, NULL, piece FROM v_parts WHERE k = 0""",
    "v_stripped": f"SELECT doc_id, k, part, meta, regexp_replace(content, '\\A[{WS}]+|[{WS}]+\\z', '', 'g') AS text FROM v_records",
    "v_kept": f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, part) - 1 AS det_index FROM v_stripped WHERE text <> '' AND (meta IS NOT NULL OR NOT (lower(text) IN ('[non-text]', '[non text]', '[non_text]')
      OR (contains(text, '<|det|>') AND NOT contains(text, '<|/det|>')) OR regexp_matches(text, '(?i)\\A[a-z][0-9a-z_-]*[{WS}]*\\[[0-9{WS},.-]*\\]\\z')))""",
    "v_dets": f"""SELECT doc_id, det_index, CASE WHEN meta IS NULL THEN 'text' ELSE trim(split_part(meta, '[', 1)) END AS type,
      CASE WHEN meta IS NULL THEN []::INT[] WHEN b[1] < b[3] AND b[2] < b[4] AND list_min(b) >= 0 AND list_max(b) <= 1000 THEN b ELSE []::INT[] END AS bbox, text
      FROM (SELECT *, list_transform(string_split(regexp_extract(coalesce(meta, ''), '\\[([^\\]]*)\\]', 1), ', '), lambda v: try_cast(v AS INT)) AS b FROM v_kept)""",
}
NEEDS = {"v_geo": ["v_lines"], "v_raw": ["v_geo"], "v_parts": ["v_raw"], "v_records": ["v_parts"], "v_stripped": ["v_records"], "v_kept": ["v_stripped"], "v_dets": ["v_kept"]}


def using(*views: str, sql: str) -> str:
    """sql with the named views, and what they need, in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    return "WITH " + ", ".join(f"{v} AS ({CTE[v]})" for v in order) + " " + sql
