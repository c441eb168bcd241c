"""Tables of the library's record shapes, derived from the given parquet tables.

Each recipe is one SELECT that Spark SQL and DuckDB read alike; where their
syntax differs a recipe holds a (Spark, DuckDB) pair.  No recipe drops rows or
cuts texts: a page of dialogue is a whole document, line by line.
"""

from __future__ import annotations

OCR_TEXTS = """
SELECT doc_id AS page_id, doc_id*10000000 + line_no + 5000000*dup AS text_id,
       CASE WHEN k % 7 = 3 THEN reverse(line) WHEN k % 3 = 0 THEN concat(' ', line, ' ')
            WHEN k % 3 = 1 THEN line ELSE replace(line, 'e', '3') END AS text,
       CAST(k*37 % 700 + k%7 + 3*dup + dx AS INT) AS x1, CAST(k*91 % 1900 + k%5 + 2*dup AS INT) AS y1,
       CAST(k*37 % 700 + 40 + k*13 % 160 + k%7 + 3*dup + dx AS INT) AS x2,
       CAST(k*91 % 1900 + 20 + k*7 % 60 + k%5 + 2*dup AS INT) AS y2,
       0.5e0 + (k%50)/100e0 AS conf
FROM (SELECT doc_id, line_no, line, dup, doc_id*31 + line_no*17 AS k,
             CASE WHEN (doc_id*31 + line_no*17) % 11 = 5 THEN 300 ELSE 0 END AS dx
      FROM {twice}) s"""

RECIPES: dict[str, str | tuple[str, str]] = {
    "lines": (
        "SELECT doc_id, lang, CAST(p AS BIGINT) AS line_no, line FROM documents LATERAL VIEW posexplode(split(text, chr(10))) s AS p, line",
        "SELECT doc_id, lang, CAST(unnest(range(len(parts))) AS BIGINT) AS line_no, unnest(parts) AS line "
        "FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents)",
    ),
    "texts": """
SELECT doc_id AS page_id, doc_id*10000000 + line_no AS text_id, line AS text, line_no,
       CAST(k*37 % 700 AS INT) AS x1, CAST(k*91 % 1900 AS INT) AS y1,
       CAST(k*37 % 700 + 40 + k*13 % 160 AS INT) AS x2, CAST(k*91 % 1900 + 20 + k*7 % 60 AS INT) AS y2
FROM (SELECT doc_id, line_no, line, doc_id*31 + line_no*17 AS k FROM lines) s""",
    "ocr_texts": (
        OCR_TEXTS.format(twice="lines LATERAL VIEW explode(array(0, 1)) d AS dup"),
        OCR_TEXTS.format(twice="(SELECT *, unnest([0, 1]) AS dup FROM lines) d"),
    ),
    "panels": """
SELECT CAST(floor(p_partkey/3) AS BIGINT) AS page_id, p_partkey AS panel_id,
       CAST(p_partkey*53 % 60 AS INT) AS x1, CAST((p_partkey%3)*640 AS INT) AS y1,
       CAST(p_partkey*53 % 60 + 500 + p_partkey*29 % 300 AS INT) AS x2,
       CAST((p_partkey%3)*640 + 560 + p_partkey*17 % 180 AS INT) AS y2,
       p_size/50e0 AS score, CAST(p_partkey*7 % 90 AS BIGINT) AS region_id
FROM part""",
    "regions": """
SELECT CAST(floor(p_partkey/120) AS BIGINT) AS page_id, CAST(floor(p_partkey/12) AS BIGINT) AS band_index, p_partkey AS region_id,
       CAST((p_partkey*53)%500 AS INT) AS x1, CAST((p_partkey*71)%600 + 900*(CAST(floor(p_partkey/12) AS BIGINT)%10) AS INT) AS y1,
       CAST((p_partkey*53)%500 + 60 + p_size*6 AS INT) AS x2,
       CAST((p_partkey*71)%600 + 60 + (p_partkey*11)%200 + 900*(CAST(floor(p_partkey/12) AS BIGINT)%10) AS INT) AS y2,
       p_size/50e0 AS score, ((p_partkey*7)%40)/100e0 AS area_ratio
FROM part""",
    "row_profile": """
SELECT image_id, y,
       CASE WHEN ph < 60 THEN 1e0 ELSE 0.3e0 END AS white_raw,
       CASE WHEN ph >= 200 AND ph < 270 THEN 1e0 ELSE 0.1e0 END AS dark_raw,
       CASE WHEN ph < 60 OR (ph >= 200 AND ph < 270) THEN 0e0 ELSE 0.05e0 END AS edge_raw,
       CASE WHEN ph < 60 THEN 250e0 WHEN ph >= 200 AND ph < 270 THEN 10e0 ELSE 60e0 + value % 150e0 END AS gray_mean
FROM (SELECT CAST(floor(event_id/2000) AS BIGINT) AS image_id, CAST(event_id % 2000 AS INT) AS y, value,
             (event_id % 2000 + 37*CAST(floor(event_id/2000) AS BIGINT)) % 400 AS ph
      FROM events) t""",
    "cut_list": """
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY kind_rank DESC, y, event_id) AS INT) AS ord, y, kind,
       strength, CAST(greatest(y - half, 0) AS INT) AS span_y1, CAST(y + half AS INT) AS span_y2
FROM (SELECT CAST(floor(event_id/40) AS BIGINT) AS image_id, event_id, CAST(10 + (event_id*67 + event_id*event_id*13) % 3980 AS INT) AS y,
             CASE WHEN event_type = 'error' THEN 'black_bar' WHEN event_type IN ('view', 'click') THEN 'gutter' ELSE 'hard_line' END AS kind,
             CASE WHEN event_type = 'error' THEN 2 WHEN event_type IN ('view', 'click') THEN 3 ELSE 1 END AS kind_rank,
             (event_id % 89)/100e0 AS strength, 9 + event_id % 20 AS half
      FROM events) s""",
    "band_list": """
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y1) - 1 AS INT) AS band_index, y1, y2, kind AS reason, score
FROM (SELECT image_id, y AS y1, lead(y, 1, 4000) OVER (PARTITION BY image_id ORDER BY y) AS y2, kind, score
      FROM (SELECT image_id, y, max(kind) AS kind, max(strength) AS score FROM cut_list GROUP BY image_id, y) d) s""",
    "patch_nodes": """
SELECT CAST(floor(vec_id/40) AS BIGINT) AS band_index, vec_id AS node_id, CAST(vec_id%40 AS INT) AS k,
       CAST((vec_id%8)*100 AS INT) AS x1, CAST(floor((vec_id%40)/8)*90 AS INT) AS y1,
       CAST((vec_id%8)*100 + 100 AS INT) AS x2, CAST(floor((vec_id%40)/8)*90 + 90 AS INT) AS y2,
       CAST(100 + (vec_id*13)%400 AS BIGINT) AS area, ((vec_id*7)%10)/10e0 AS edge_mean,
       ((vec_id*3)%10)/10e0 AS non_white_ratio,
       CAST((label*25)%256 AS DOUBLE) AS mean_b, CAST((label*60)%256 AS DOUBLE) AS mean_g,
       CAST((label*90)%256 AS DOUBLE) AS mean_r,
       CASE WHEN label%3=0 THEN 1e0 ELSE 0.2e0 END AS e0, CASE WHEN label%3=1 THEN 1e0 ELSE 0.2e0 END AS e1,
       CASE WHEN label%3=2 THEN 1e0 ELSE 0.2e0 END AS e2
FROM embeddings""",
    "patch_edges": """
SELECT a.band_index, a.node_id AS a, b.node_id AS b, ((a.node_id*31 + b.node_id*17)%100)/100e0 AS boundary_cost
FROM patch_nodes a JOIN patch_nodes b ON a.band_index = b.band_index
 AND ((b.node_id = a.node_id + 1 AND a.node_id%8 < 7) OR b.node_id = a.node_id + 8)""",
    "layers": """
SELECT o_custkey AS page_id, o_orderkey AS layer_id,
       CASE o_orderstatus WHEN 'F' THEN 'group' WHEN 'O' THEN 'pixel' ELSE 'type' END AS kind,
       o_orderpriority <> '5-LOW' AS visible,
       CAST(floor(o_totalprice) AS BIGINT) % 5000 AS layer_pixels,
       CAST(floor((CAST(floor(o_totalprice) AS BIGINT) % 5000) * (o_orderkey%101) / 100e0) AS BIGINT) AS overlap_pixels,
       CAST((o_orderkey*7)%900 AS INT) AS rgba_elapsed_ms,
       CAST((o_orderkey*53)%900 - 60 AS INT) AS x1, CAST((o_orderkey*71)%2100 - 60 AS INT) AS y1,
       CAST((o_orderkey*53)%900 - 60 + (o_orderkey*7)%220 AS INT) AS x2, CAST((o_orderkey*71)%2100 - 60 + (o_orderkey*11)%90 AS INT) AS y2,
       o_orderkey%13 = 0 AS is_excluded,
       CASE WHEN o_orderkey%5 = 0 THEN concat(' ', chr(13), ' ') ELSE concat('  ', o_orderpriority, chr(13), CAST(o_orderkey AS VARCHAR(20)), chr(13)) END AS layer_text
FROM orders""",
    "layer_seq": """
SELECT o_custkey AS page_id, o_orderkey AS layer_id, o_orderpriority AS name, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS pos FROM orders""",
    "layer_tree": """
SELECT c.page_id, c.layer_id, c.name, c.pos, p.layer_id AS above
FROM layer_seq c LEFT JOIN layer_seq p ON p.page_id = c.page_id AND p.pos = CAST(floor((c.pos+2)/4) AS BIGINT) AND c.pos > 1""",
    "runs": """
SELECT concat('run_', CAST(o_orderkey AS VARCHAR(20))) AS id, o_orderkey AS run_no,
       concat('asset_', CAST(o_custkey%400 AS VARCHAR(20)), '.psd') AS file,
       CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
       CASE WHEN o_orderkey%3=0 THEN 'stage2' ELSE 'bands' END AS split_mode,
       CAST(o_orderkey%12 AS INT) AS panel_count, CAST(o_orderkey%25 AS INT) AS text_count,
       CAST(o_orderkey%7 AS INT) AS assigned_count,
       o_orderkey%4 <> 0 AS has_pipeline_meta, o_orderdate AS mtime, o_orderkey%5 = 1 AS has_ui_meta,
       CASE WHEN o_orderkey%6 = 0 THEN '' ELSE concat('note ', o_orderpriority) END AS note
FROM orders""",
    "ocr_responses": """
SELECT event_id, replace(CASE event_id % 6
 WHEN 0 THEN concat('{"code":10000,"request_id":"r', CAST(event_id AS VARCHAR(20)), '","data":{"ocr_infos":[{"lang":"zh","text":"', event_type, '","prob":', CAST(event_id%100 AS VARCHAR(20)), ',"rect":[', CAST(event_id%50 AS VARCHAR(20)), ',2,60,40]}]}}')
 WHEN 1 THEN concat('{"data":{"ocr_infos":[{"lang":"ko","content":"', event_type, '","confidence":"0.5","points":[[1,2],[30,2],[30,9],[1,9]]},{"lang":"en","text":"x","rect":[1,1,2,2]}]}}')
 WHEN 2 THEN concat('{"ResponseMetadata":{"RequestId":"m', CAST(event_id AS VARCHAR(20)), '"},"Result":{"Output":"{#"texts#":[{#"Content#":#"', event_type, '#",#"Location#":[1,2,3,2,3,4,1,4]}]}"}}')
 WHEN 3 THEN concat('{"result":[{"block_content":"', event_type, '","block_bbox":[5,6,70,80]}]}')
 WHEN 4 THEN concat('{"data":{"detail":"[{#"textblocks#":[{#"text#":#"', event_type, '#",#"x0#":1,#"y0#":2,#"x1#":9,#"y1#":8,#"score#":0.9}]}]"}}')
 ELSE '{"code":50000,"message":"bad gateway"}' END, '#', chr(92)) AS resp
FROM events""",
    "segments": """
SELECT CAST(floor(l_orderkey/100) AS BIGINT) AS image_id, l_orderkey AS seg_a, l_linenumber AS seg_b, l_partkey AS seg_c,
       CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey/100) AS BIGINT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS BIGINT) AS seg_id,
       CAST(l_suppkey%200 AS INT) AS sx1, CAST((l_partkey*7)%1000 AS INT) AS sy1,
       CAST(l_suppkey%200 + 400 + l_partkey%500 AS INT) AS sx2,
       CAST((l_partkey*7)%1000 + CASE WHEN l_linenumber%2=0 THEN 0 ELSE l_partkey%9 END AS INT) AS sy2
FROM lineitem""",
    "pixels": """
SELECT CAST(floor(event_id/500) AS BIGINT) AS image_id,
       CAST(floor((event_id%500)/20) AS INT) AS y, CAST(event_id%20 AS INT) AS x,
       CAST((event_id*13)%256 AS INT) AS b, CAST((event_id*29)%256 AS INT) AS g, CAST(CAST(floor(value) AS BIGINT)%256 AS INT) AS r,
       CAST(floor((event_id%20)/5) + 4*floor((event_id%500)/100) AS INT) AS label
FROM events""",
    "box_pairs": """
SELECT pair_id, ax1, ay1, ax1 + aw AS ax2, ay1 + ah AS ay2, bx1, by1, bx1 + bw AS bx2, by1 + bh AS by2, has_quad,
       ax1 + 0.25e0 AS q0x, ay1 - 0.5e0 AS q0y, ax1 + aw + 0.75e0 AS q1x, ay1 + 0.5e0 AS q1y,
       ax1 + aw - 0.25e0 AS q2x, ay1 + ah + 0.25e0 AS q2y, ax1 - 1.5e0 AS q3x, ay1 + ah - 0.75e0 AS q3y, canvas_w, canvas_h
FROM (SELECT l_orderkey*8 + l_linenumber AS pair_id, l_linenumber%2 = 0 AS has_quad,
             CAST(l_partkey*37 % 900 - 50 AS INT) AS ax1, CAST(l_suppkey*91 % 2000 - 50 AS INT) AS ay1,
             CAST(l_orderkey*13 % 160 - 8 AS INT) AS aw, CAST(l_orderkey*7 % 60 - 4 AS INT) AS ah,
             CAST(l_partkey*37 % 900 - 110 + l_orderkey*11 % 120 AS INT) AS bx1, CAST(l_suppkey*91 % 2000 - 90 + l_orderkey*5 % 80 AS INT) AS by1,
             CAST(l_partkey*17 % 200 AS INT) AS bw, CAST(l_suppkey*3 % 90 AS INT) AS bh,
             CASE WHEN l_linenumber = 7 THEN 0 ELSE 800 END AS canvas_w, 1900 AS canvas_h
      FROM lineitem) s""",
}


def spark_text(name: str) -> str:
    recipe = RECIPES[name]
    return recipe if isinstance(recipe, str) else recipe[0]


def duck_text(name: str) -> str:
    recipe = RECIPES[name]
    return recipe if isinstance(recipe, str) else recipe[1]
