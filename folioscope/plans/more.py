"""Registered queries of scalar functions, controls and sequences over plain tables; ``catalog`` imports this module last."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import geometry as G
from ..functions import text as T
from ..operators import experts, figures, hybrid, layout, prompts, sequences, state, tables, tiling
from ..sources import fixtures as V
from ..sources import providers, sinks
from .catalog import LONG, TOP, chosen, parsed, register
from .oracles import WS, using



def stripped(sql: str) -> str:
    return "regexp_replace(" + sql + ", '\\A[" + WS + "]+|[" + WS + "]+\\z', '', 'g')"


# ---------------------------------------------------------------- text

TABULAR_TEXT = "text || CASE doc_id % 6 WHEN 0 THEN chr(10) || 'see Table 7 below' WHEN 1 THEN chr(10) || 'Parameter and Symbol' WHEN 2 THEN ' Bit 7 6 5 4 Content' WHEN 3 THEN ' vegetable 7' ELSE '' END"


@register(f"SELECT doc_id, regexp_matches({TABULAR_TEXT}, '{tables.TABULAR}') AS tabular FROM documents")
def looks_tabular(s, d):
    doc = F.col("doc_id") % 6
    more = F.when(doc == 0, "\nsee Table 7 below").when(doc == 1, "\nParameter and Symbol").when(doc == 2, " Bit 7 6 5 4 Content").when(doc == 3, " vegetable 7").otherwise("")
    return V.table(s, d, "documents").select("doc_id", tables.looks_tabular(F.concat("text", more)).alias("tabular"))


@register(using("v_dets", sql="SELECT doc_id, count(*)::INT AS n, sum(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10ffff}]')))::INT AS characters FROM v_dets GROUP BY doc_id"))
def detection_statistics(s, d):
    rows = parsed(s, d).where("size(dets) > 0").select("doc_id", sinks.text_statistics(F.col("dets")).alias("t"))
    return rows.select("doc_id", F.col("t.count").alias("n"), "t.characters")


SIZE = "(p_partkey * 7919 + p_size * 104729)"


@register(f"SELECT p_partkey, CASE WHEN {SIZE} < 1048576 THEN floor({SIZE} / 1024 + 0.5)::BIGINT || ' KB' ELSE printf('%.1f MB', {SIZE} / 1048576) END AS shown FROM part")
def byte_sizes(s, d):
    return V.table(s, d, "part").select("p_partkey", T.format_bytes(F.expr(SIZE)).alias("shown"))


GENERATED = "CASE doc_id % 4 WHEN 0 THEN '  loose <|det|>text [1, 2, 3, 4]<|/det|>' || text || '<｜end▁of▁sentence｜>' WHEN 1 THEN '<|det|>title [1, 2, 3, 4]<|/det|>' || text WHEN 2 THEN text || '<｜end▁of▁sentence｜>  ' ELSE text END"


@register(f"SELECT doc_id, CASE WHEN strpos(t, '<|det|>') > 1 THEN substr(t, strpos(t, '<|det|>')) ELSE t END AS text FROM (SELECT doc_id, {stripped("replace(" + GENERATED + ", '" + T.END_OF_SENTENCE + "', '')")} AS t FROM documents)")
def generated_clean(s, d):
    k, text, end = F.col("doc_id") % 4, F.col("text"), F.lit(T.END_OF_SENTENCE)
    made = F.when(k == 0, F.concat(F.lit("  loose <|det|>text [1, 2, 3, 4]<|/det|>"), text, end)).when(k == 1, F.concat(F.lit("<|det|>title [1, 2, 3, 4]<|/det|>"), text)).when(k == 2, F.concat(text, end, F.lit("  "))).otherwise(text)
    return V.table(s, d, "documents").select("doc_id", T.clean_generated(made).alias("text"))


@register("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text || ' the angles phi and Theta, alphi, _ _  _ end', '\\bphi\\b', 'φ', 'g'), '\\bTheta\\b', 'θ', 'g'), '_\\s+_\\s+_', '—', 'g') AS markdown FROM documents")
def math_converted(s, d):
    return V.table(s, d, "documents").select("doc_id", T.convert_math(F.concat("text", F.lit(" the angles phi and Theta, alphi, _ _  _ end"))).alias("markdown"))


@register("SELECT page_id, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) AS suffix, regexp_replace(regexp_extract(name, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM (SELECT page_id, url || '/Page.' || page_id || CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.tar.gz' ELSE '' END AS name FROM pages)")
def file_names(s, d):
    name = F.concat("url", F.lit("/Page."), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".PDF").when(F.col("page_id") % 3 == 1, ".tar.gz").otherwise(""))
    return V.table(s, d, "pages").select("page_id", T.suffix(name).alias("suffix"), T.stem(name).alias("stem"))


@register("SELECT doc_id, 'data:image/png;base64,' || to_base64(encode(text)) AS uri FROM documents")
def data_uris(s, d):
    return V.table(s, d, "documents").select("doc_id", F.regexp_replace(providers.data_uri(F.col("text").cast("binary")), "[\r\n]", "").alias("uri"))


@register(f"""WITH l AS (SELECT doc_id, unnest(string_split(CASE doc_id % 3 WHEN 0 THEN 'KEY = a = ' || doc_id WHEN 1 THEN '# note = 1' ELSE ' NAME' || doc_id || '=' END || chr(10) || 'no pair' || chr(10) || 'ID' || doc_id || ' = x', chr(10))) AS value FROM documents),
    t AS (SELECT {stripped('value')} AS line FROM l) SELECT {stripped("split_part(line, '=', 1)")} AS name, {stripped("substr(line, strpos(line, '=') + 1)")} AS value FROM t WHERE line <> '' AND NOT starts_with(line, '#') AND contains(line, '=') AND {stripped("split_part(line, '=', 1)")} <> 'ID7'""")
def environment_lines(s, d):
    doc, k = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    first = F.when(k == 0, F.concat(F.lit("KEY = a = "), doc)).when(k == 1, F.lit("# note = 1")).otherwise(F.concat(F.lit(" NAME"), doc, F.lit("=")))
    lines = V.table(s, d, "documents").select(F.explode(F.array(first, F.lit("no pair"), F.concat(F.lit("ID"), doc, F.lit(" = x")))).alias("value"))
    return providers.environment(lines, s.createDataFrame([("ID7",)], "name string"))


# ---------------------------------------------------------------- geometry and layout

OVERLAY = ", ".join(f"trunc({c}::DOUBLE / 999 * {size})::INT AS p{c}" for c, size in (("x0", 1654), ("y0", 2339), ("x1", 1654), ("y1", 2339)))


@register(using("v_geo", sql=f"SELECT doc_id, line_no, {OVERLAY}, x0 / 10 AS left_pc, y0 / 10 AS top_pc, (x1 - x0) / 10 AS width_pc, (y1 - y0) / 10 AS height_pc FROM v_geo"))
def box_overlays(s, d):
    box = F.array(*(F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1")))
    rows = V.geo(s, d).select("doc_id", F.col("line_no").cast(LONG).alias("line_no"), G.overlay_pixels(box, F.lit(1654), F.lit(2339)).alias("px"), G.overlay_percent(box).alias("pc"))
    return rows.select("doc_id", "line_no", *(F.get("px", k).alias("p" + c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), *(F.get("pc", k).alias(c) for k, c in enumerate(("left_pc", "top_pc", "width_pc", "height_pc"))))


SPAN_LINES = f"""(SELECT doc_id, line_no, line_no // 4 AS block_no, x0, y0, line_no % 17 = 0 AS bold, regexp_replace(regexp_replace(array_to_string(list_transform(range(len(w)), lambda k: CASE WHEN k = 0 THEN '' WHEN k % 5 = 4 AND k % 7 = 4 THEN '^' WHEN k % 5 = 4 THEN '' WHEN k % 3 = 2 THEN ' ' ELSE '' END || w[k + 1]), ''), ' +', ' ', 'g'), '\\A[{WS}]+|[{WS}]+\\z', '', 'g') AS text
    FROM (SELECT doc_id, line_no, x0, y0, list_filter(string_split(text, ' '), lambda x: {stripped('x')} <> '') AS w FROM v_geo) WHERE len(w) > 0)"""


@register(using("v_geo", sql=f"SELECT doc_id, block_no, text, 10.0::DOUBLE AS size, bold, row_number() OVER (PARTITION BY doc_id ORDER BY y0, x0, block_no, line_no) - 1 AS order_no FROM {SPAN_LINES} WHERE text <> ''"))
def lines_from_spans(s, d):
    return layout.lines_from_spans(V.spans(s, d)).select("doc_id", F.col("block_no").cast(LONG).alias("block_no"), "text", "size", "bold", "order_no")


@register(using("v_geo", sql=f"SELECT doc_id, count(DISTINCT block_no) AS text_blocks FROM {SPAN_LINES} WHERE text <> '' GROUP BY doc_id"))
def text_blocks(s, d):
    return layout.block_counts(layout.lines_from_spans(V.spans(s, d)))


def placed(s, d):
    """Boxes by parts: x0, y0, x1, y1 as doubles."""
    p, n = F.col("p_partkey"), F.col("p_size")
    return V.table(s, d, "part").select("p_partkey", (p % 40).cast("double").alias("x0"), (n * 20 - 10).cast("double").alias("y0"), (p % 40 + p * 13 % 580).cast("double").alias("x1"), (n * 20 + p * 7 % 900).cast("double").alias("y1"))


PLACED = "(SELECT p_partkey, (p_partkey % 40)::DOUBLE AS x0, (p_size * 20 - 10)::DOUBLE AS y0, (p_partkey % 40 + p_partkey * 13 % 580)::DOUBLE AS x1, (p_size * 20 + p_partkey * 7 % 900)::DOUBLE AS y1 FROM part)"


@register(f"SELECT p_partkey, x1 - x0 >= 60 AND y1 - y0 >= 60 AND NOT (x1 - x0 > 510 AND y1 - y0 > 850) AND y0 >= 80 AND y1 <= 950 AS content FROM {PLACED}")
def content_images(s, d):
    return placed(s, d).select("p_partkey", figures.is_content_image(V.PAGE).alias("content"))


@register(f"SELECT p_partkey, greatest(0, least(x1, 300) - greatest(x0, 20)) * greatest(0, least(y1, 600) - greatest(y0, 100)) AS area, least(1.0, greatest(0, least(x1, 600) - greatest(x0, 0)) * greatest(0, least(y1, 1000) - greatest(y0, 0)) / 600000 * 2)::DOUBLE AS coverage FROM {PLACED}")
def box_coverage(s, d):
    own = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    area = G.overlap_area(own, [F.lit(float(v)) for v in (20, 100, 300, 600)])
    return placed(s, d).select("p_partkey", area.alias("area"), G.image_coverage(F.array(F.array(*own), F.array(*own)), [F.lit(v) for v in V.PAGE]).alias("coverage"))


REGION = "least(1000, greatest(0, 100 + round_even({0} / 1000 * 800, 0)))::INT || ',' || least(1000, greatest(0, 200 + round_even({1} / 1000 * 600, 0)))::INT"


@register(using("v_dets", sql=f"SELECT doc_id, det_index, type, CASE WHEN len(bbox) = 4 THEN {REGION.format('bbox[1]', 'bbox[2]')} || ',' || {REGION.format('bbox[3]', 'bbox[4]')} ELSE '' END AS bbox, 'vlm' AS source FROM v_dets"))
def mapped_detections(s, d):
    made = parsed(s, d).select("doc_id", F.posexplode(hybrid.map_detections(F.col("dets"), F.lit([100, 200, 900, 800]))).alias("k", "x"))
    return made.select("doc_id", F.col("k").cast(LONG).alias("det_index"), "x.type", F.array_join(F.col("x.bbox").cast("array<string>"), ",").alias("bbox"), "x.source")


# ---------------------------------------------------------------- tables

REAL = "WITH r AS (SELECT page, part % 3 AS row_no, count(*) AS n FROM v_cells GROUP BY page, part % 3), p AS (SELECT page, count(*) AS rows, count(*) FILTER (n >= 2) AS wide, sum(n) AS filled FROM r GROUP BY page)"


@register(using("v_cells", sql=f"{REAL.replace('WITH r', ', r')} SELECT page, page % 50 + 10 >= 25 AND page % 7 * 60 + 60 >= 180 AND rows >= 2 AND wide >= 2 AS genuine, page % 50 + 10 >= 25 AND page % 7 * 60 + 60 >= 180 AND rows >= 2 AND wide >= 2 AND filled >= 6 AS real FROM p"))
def real_tables(s, d):
    rows = V.cells(s, d).withColumn("row_no", F.col("part") % 3).groupBy("page", "row_no").agg(F.collect_list(F.col("value").cast("string")).alias("cells")).groupBy("page").agg(F.collect_list("cells").alias("grid"))
    box = [F.lit(0), F.lit(0), F.col("page") % 7 * 60 + 60, F.col("page") % 50 + 10]
    return rows.select("page", tables.is_genuine(*box, F.size("grid"), F.col("grid")).alias("genuine"), tables.is_real(*box, F.size("grid"), F.col("grid")).alias("real"))


@register("""SELECT p_partkey, CASE WHEN a + b + c >= 2 THEN array_to_string(list_filter([CASE WHEN a = 1 THEN 'x' END, CASE WHEN b = 1 THEN 'y' || p_size END, CASE WHEN c = 1 THEN 'z' END], lambda v: v IS NOT NULL), '|') END AS first_row
    FROM (SELECT *, (p_partkey % 2 = 0)::INT AS a, (p_partkey % 3 > 0)::INT AS b, (p_partkey % 5 > 0)::INT AS c FROM part)""")
def kept_columns(s, d):
    p = F.col("p_partkey")
    cell = lambda ok, v: F.when(ok, v).otherwise(F.lit(""))
    row = F.array(cell(p % 2 == 0, F.lit("x")), cell(p % 3 > 0, F.concat(F.lit("y"), F.col("p_size").cast("string"))), cell(p % 5 > 0, F.lit("z")))
    blank = F.array(F.lit(""), F.lit(""), F.lit(""))
    return V.table(s, d, "part").select("p_partkey", F.array_join(F.get(tables.kept_columns(F.array(row, blank)), 0), "|").alias("first_row"))


# ---------------------------------------------------------------- tiling, experts, sequences


@register("SELECT p_partkey, round(1 - (greatest(w, h) - least(w, h)) / greatest(w, h), 9) AS share, w // 14 AS tile_row, h // 14 AS tile_col, w % 14 AS row, h % 14 AS col, (w + 13) // 14 * 14 AS padded FROM (SELECT p_partkey, (p_size * 40 + 100)::DOUBLE::BIGINT AS w, p_partkey % 37 * 50 + 120 AS h FROM part)")
def window_tiles(s, d):
    w, h = F.col("p_size") * 40 + 100, F.col("p_partkey") % 37 * 50 + 120
    rows = V.table(s, d, "part").select("p_partkey", w.cast(LONG).alias("w"), h.cast(LONG).alias("h"))
    tile = tiling.window_tile(F.col("w"), F.col("h"), 14)
    return rows.select("p_partkey", F.round(tiling.square_ratio(F.col("w"), F.col("h")), 9).alias("share"), *(tile[c].alias(c) for c in ("tile_row", "tile_col", "row", "col")), tiling.padded(F.col("w"), 14).alias("padded"))


@register("SELECT p_partkey, 17 * 16 + 1 + CASE WHEN c > 1 OR r > 1 THEN (10 * c + 1) * (10 * r) ELSE 0 END AS tokens, 7 AS token, (c + 1) * r + 1 AS places FROM (SELECT p_partkey, p_size % 4 + 1 AS c, p_partkey % 3 + 1 AS r FROM part)")
def image_token_ids(s, d):
    c, r = (F.col("p_size") % 4 + 1).cast("int"), (F.col("p_partkey") % 3 + 1).cast("int")
    ids = tiling.layout_ids(c, r, 7)
    return V.table(s, d, "part").select("p_partkey", F.size(ids).cast(LONG).alias("tokens"), F.when(F.size(F.array_distinct(ids)) == 1, F.get(ids, 0)).alias("token"), F.size(sequences.grid_rows(r, c)).cast(LONG).alias("places"))


@register(using("v_scores", sql=f", n AS (SELECT count(*) AS n FROM v_scores), l AS (SELECT expert, count(*) AS tokens FROM {TOP} GROUP BY expert), m AS (SELECT expert, avg(score) AS mean FROM (SELECT unnest(range(len(scores))) AS expert, unnest(scores)::DOUBLE AS score FROM v_scores) GROUP BY expert) SELECT round(sum(tokens / (n * 6.0::DOUBLE) * 64 * mean) * 0.001, 7) AS aux_loss FROM l JOIN m USING (expert), n"))
def auxiliary_loss(s, d):
    rows = V.scores(s, d).select("scores", experts.route(F.col("scores"), 6).alias("chosen"))
    return experts.auxiliary_loss(rows.withColumn("scores", F.col("scores").cast("array<double>")), "scores", "chosen", 64, 6).select(F.round("aux_loss", 7).alias("aux_loss"))


@register(using("v_scores", sql=f"SELECT row_id, round(sum(expert * score), 5) AS answer FROM {TOP} GROUP BY row_id"))
def expert_answers(s, d):
    sent = experts.dispatch(chosen(s, d), "row_id").withColumn("answer", F.col("expert").cast("double"))
    return experts.collect_back(sent, "row_id", "answer").select("row_id", F.round("answer", 5).alias("answer"))


MASK = "list_transform(range(0, p_size % 13 + 1), lambda k: CASE WHEN (p_partkey + k * k) % 3 <> 0 THEN 1 ELSE 0 END)"


@register(f"""SELECT p_partkey, list_sum(m)::INT AS length, coalesce(array_to_string(list_filter(range(len(m)), lambda k: m[k + 1] = 1), ','), '') AS places,
    array_to_string(list_transform(range(len(m)), lambda k: CASE WHEN m[k + 1] = 1 THEN list_sum(m[1:k + 1])::INT - 1 ELSE 1 END), ',') AS positions FROM (SELECT p_partkey, {MASK} AS m FROM part)""")
def mask_positions(s, d):
    mask = F.transform(F.sequence(F.lit(0), F.col("p_size") % 13), lambda k: ((F.col("p_partkey") + k * k) % 3 != 0).cast("int"))
    rows = V.table(s, d, "part").select("p_partkey", mask.alias("m"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("p_partkey", sequences.unpadded(F.col("m")).alias("u"), "m").select("p_partkey", "u.length", text(F.col("u.places")).alias("places"), text(sequences.positions(F.col("m"))).alias("positions"))


@register(f"""SELECT p_partkey, array_to_string(list_transform(range(1, len(m)), lambda k: m[k] || '>' || m[k + 1]), ' ') AS pairs, array_to_string(flatten(list_transform(m, lambda v: [v, v])), '') AS twice,
    array_to_string(list_transform(range(len(m)), lambda k: CASE WHEN m[k + 1] = 1 THEN 100 + list_sum(m[1:k + 1])::INT - 1 ELSE 7 END), ',') AS filled FROM (SELECT p_partkey, {MASK} AS m FROM part)""")
def sequence_shapes(s, d):
    mask = F.transform(F.sequence(F.lit(0), F.col("p_size") % 13), lambda k: ((F.col("p_partkey") + k * k) % 3 != 0).cast("int"))
    rows = V.table(s, d, "part").select("p_partkey", mask.alias("m"))
    pairs = F.array_join(F.transform(sequences.shifted(F.col("m")), lambda p: F.concat(p["given"].cast("string"), F.lit(">"), p["next"].cast("string"))), " ")
    slots, values, own = F.transform("m", lambda v: v == 1), F.sequence(F.lit(100), F.lit(120)), F.transform("m", lambda v: F.lit(7))
    return rows.select("p_partkey", pairs.alias("pairs"), F.array_join(sequences.repeated(F.col("m"), 2).cast("array<string>"), "").alias("twice"), F.array_join(sequences.filled_slots(slots, values, own).cast("array<string>"), ",").alias("filled"))


@register(using("v_scores", sql="SELECT row_id, round(list_max(s) / sqrt(list_sum(list_transform(s, lambda v: v * v)) / len(s) + 1e-6), 4) AS rms_max, round((list_max(s) - list_avg(s)) / sqrt(list_var_pop(s) + 1e-6), 4) AS layer_max FROM (SELECT row_id, scores::DOUBLE[] AS s FROM v_scores)"))
def norms(s, d):
    return V.scores(s, d).select("row_id", F.round(F.array_max(sequences.rms_norm(F.col("scores"))), 4).alias("rms_max"), F.round(F.array_max(sequences.layer_norm(F.col("scores"))), 4).alias("layer_max"))


@register(using("v_scan", sql="SELECT session_id, tokens, seconds, CASE WHEN seconds > 0 THEN round(tokens / seconds, 1) END AS tokens_per_second FROM (SELECT session_id, max(event_id % 1000) AS tokens, round(max(event_id % 97) / 7.0::DOUBLE, 2) AS seconds FROM v_scan GROUP BY session_id)"))
def token_throughput(s, d):
    rows = V.scan(s, d).select("session_id", (F.col("event_id") % 1000).alias("tokens"), (F.col("event_id") % 97 / 7.0).alias("seconds"))
    return sequences.throughput(rows, ["session_id"])


# ---------------------------------------------------------------- scans


@register(using("v_scan", sql="SELECT session_id, count(*) AS processed, least(100, floor(count(*) / (session_id % 7 + 20)::DOUBLE * 100 + 0.5))::INT AS percent FROM v_scan GROUP BY session_id"))
def upload_progress(s, d):
    return api.progress(V.scan(s, d), F.col("session_id") % 7 + 20)


@register(using("v_scan", sql="""SELECT * FROM (SELECT event_id, session_id, page_num, force_mode, CASE WHEN session_id % 3 = 0 THEN 'Session not found' WHEN page_num < 1 OR page_num > session_id % 4 + 1 THEN 'Page not found' WHEN force_mode = 'magic' THEN 'Invalid force_mode' END AS reason
    FROM (SELECT event_id, session_id, page_num, CASE event_id % 3 WHEN 0 THEN 'vlm' WHEN 1 THEN 'magic' END AS force_mode FROM v_scan)) WHERE reason IS NOT NULL"""))
def request_checks(s, d):
    asked = V.scan(s, d).select("event_id", "session_id", "page_num", F.when(F.col("event_id") % 3 == 0, "vlm").when(F.col("event_id") % 3 == 1, "magic").alias("force_mode"))
    known = V.scan(s, d).where("session_id % 3 <> 0").select("session_id", (F.col("session_id") % 4 + 1).alias("total_pages")).distinct()
    return state.invalid_requests(asked, known).select("event_id", "session_id", "page_num", "force_mode", "reason")


@register(using("v_scan", sql="""SELECT session_id, event_id, event FROM (SELECT *, last_value(action IGNORE NULLS) OVER w AS now, max((action = 'stop')::INT) OVER w AS stopped FROM
    (SELECT session_id, event_id, event, CASE WHEN event_id % 97 = 0 THEN 'stop' WHEN event_id % 10 = 0 THEN 'pause' WHEN event_id % 10 = 5 THEN 'resume' END AS action FROM v_scan) WINDOW w AS (PARTITION BY session_id ORDER BY event_id))
    WHERE coalesce(now, 'resume') = 'resume' AND coalesce(stopped, 0) = 0"""))
def pause_controls(s, d):
    rows = V.scan(s, d).select("session_id", "event_id", "event")
    n = F.col("event_id")
    action = F.when(n % 97 == 0, "stop").when(n % 10 == 0, "pause").when(n % 10 == 5, "resume")
    return api.controlled(rows, rows.select("session_id", n.alias("at"), action.alias("action")).where("action is not null"), "event_id")


@register(using("v_scan", sql="""SELECT session_id, CASE WHEN session_id % 5 = 0 THEN 'scan_stopped' ELSE 'scan_complete' END AS event, count(*) AS total_pages, count(*) FILTER (state IN ('done', 'warning')) AS done_pages, count(*) FILTER (state = 'failed') AS failed_pages
    FROM (SELECT session_id, page_num, arg_max(CASE event WHEN 'error' THEN 'failed' WHEN 'page_start' THEN 'processing' ELSE 'done' END, (ts, event_id)) FILTER (event IN ('page_start', 'page_done', 'error')) AS state FROM v_scan GROUP BY 1, 2) GROUP BY session_id"""))
def closing_events(s, d):
    rows = V.scan(s, d).withColumn("truncated", F.lit(False)).withColumn("warnings", F.lit(0)).withColumn("message", F.lit(None).cast("string"))
    return state.scan_events(state.page_states(rows, ["ts", "event_id"]), rows.where("session_id % 5 = 0").select("session_id"))


@register(using("v_scan", sql="SELECT event_id, event, '{\"a\":' || event_id || '}' AS data FROM v_scan UNION ALL SELECT event_id, 'done', '[]' FROM v_scan WHERE event_id % 2 = 0"))
def frames_parsed(s, d):
    n = F.col("event_id").cast("string")
    text = F.concat(F.lit("event: "), F.col("event"), F.lit('\ndata: {"a":'), n, F.lit("}\n\nevent: none\n\ndata: 1\n\nevent: bad\ndata: {a\n\n"), F.when(F.col("event_id") % 2 == 0, "event:done\r\ndata:[]\r\n\r\n").otherwise(""))
    return V.scan(s, d).select("event_id", F.explode(state.parse_frames(text)).alias("f")).select("event_id", "f.event", "f.data")


TURNS = f"(SELECT conv_id, role, {stripped("coalesce(text, '')")} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations)"


@register(f"SELECT conv_id, {stripped("string_agg(CASE WHEN t = '' THEN '' WHEN k % 2 = 0 THEN '<image>' || chr(10) ELSE t END, '' ORDER BY k)")} AS prompt FROM {TURNS} GROUP BY conv_id")
def prompt_alignment(s, d):
    return prompts.turns(V.conversations(s, d), ["conv_id"], "turn").select("conv_id", prompts.render(F.col("messages"), prompts.TEMPLATES["alignment"]).alias("prompt"))


@register(f"SELECT conv_id, {stripped("string_agg(CASE WHEN t = '' THEN role || ':' ELSE role || ': ' || t || CASE WHEN k % 2 = 0 THEN '' ELSE '" + T.END_OF_SENTENCE + "' END END, '' ORDER BY k)")} AS prompt FROM {TURNS} GROUP BY conv_id")
def prompt_deepseekv2(s, d):
    return prompts.turns(V.conversations(s, d), ["conv_id"], "turn").select("conv_id", prompts.render(F.col("messages"), prompts.TEMPLATES["deepseekv2"]).alias("prompt"))


@register("SELECT p_partkey, '0,' || p_size || ',' || p_partkey AS opened, p_size || ',' || p_partkey || ',1' AS closed FROM part")
def marked_ids(s, d):
    ids = F.array(F.col("p_size").cast(LONG), F.col("p_partkey").cast(LONG))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return V.table(s, d, "part").select("p_partkey", text(prompts.with_marks(ids)).alias("opened"), text(prompts.with_marks(ids, False, True)).alias("closed"))
