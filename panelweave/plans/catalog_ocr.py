"""OCR answer and request queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import errors as E
from panelweave.functions import ocr_json as O
from panelweave.operators.spread import row_numbers
from panelweave.plans.recipes import RECIPES
from panelweave.plans.registry import query
from panelweave.session import dealt

KEY = ["event_id"]
N = "CAST(event_id%50 AS VARCHAR(20))"
RECIPES["ocr_items"] = f"""
SELECT event_id, event_type, CASE event_id % 8
 WHEN 0 THEN concat('{{"Content":" ', event_type, ' ","Confidence":', {N}, ',"Location":{{"LeftTop":{{"X":1,"Y":2}},"RightTop":{{"x":', {N}, ',"y":2}},"right_bottom":{{"X":9,"Y":8.5}},"LeftBottom":{{"X":1,"Y":8}}}}}}')
 WHEN 1 THEN concat('{{"text":"', event_type, '","score":"0.5","x0":', {N}, ',"y0":2,"right":60,"bottom":40}}')
 WHEN 2 THEN concat('{{"words":" ","Word":"', event_type, '","Score":"x","probability":0.25,"bbox":{{"left":1,"top":', {N}, ',"right":30,"bottom":40}}}}')
 WHEN 3 THEN concat('{{"block_text":"', event_type, '","rect":{{"x":1,"y":2,"w":10,"height":', {N}, '}}}}')
 WHEN 4 THEN concat('{{"value":"', event_type, '","quad":{{"points":[[1,2],[3,2],[3,', {N}, '],[1,4]]}}}}')
 WHEN 5 THEN concat('{{"Text":7,"ocrText":"', event_type, '","polygon":[1,2,3,2,3,4,1,', {N}, '],"prob":" 0.75 "}}')
 WHEN 6 THEN concat('{{"content":"', event_type, '","Box":[5,6,70,', {N}, ']}}')
 ELSE '{{"lang":"zh","coordinates":[[1,2],[3,4]]}}' END AS item
FROM events"""


def answers(t):
    return dealt(t("ocr_responses"), "event_id")


def items(t):
    return t("ocr_items").withColumn("v", F.try_parse_json("item"))


@query("ocr_text_field", "SELECT event_id, CASE WHEN event_id%8<7 THEN event_type END AS text FROM ocr_items")
def _(t):
    return items(t).select("event_id", O.text_field(F.col("v")).alias("text"))


@query("ocr_confidence", "SELECT event_id, CASE event_id%8 WHEN 0 THEN CAST(event_id%50 AS DOUBLE) WHEN 1 THEN 0.5e0 WHEN 2 THEN 0.25e0 WHEN 5 THEN 0.75e0 END AS confidence FROM ocr_items")
def _(t):
    return items(t).select("event_id", O.confidence(F.col("v")).alias("confidence"))


@query(
    "ocr_quad",
    """SELECT event_id, CASE event_id%8 WHEN 0 THEN concat('1.0 2.0,',n,' 2.0,9.0 8.5,1.0 8.0') WHEN 1 THEN concat(n,' 2.0,60.0 2.0,60.0 40.0,',n,' 40.0') WHEN 2 THEN concat('1.0 ',n,',30.0 ',n,',30.0 40.0,1.0 40.0')
       WHEN 3 THEN concat('1.0 2.0,11.0 2.0,11.0 ',m,',1.0 ',m) WHEN 4 THEN concat('1.0 2.0,3.0 2.0,3.0 ',n,',1.0 4.0') WHEN 5 THEN concat('1.0 2.0,3.0 2.0,3.0 4.0,1.0 ',n) WHEN 6 THEN concat('5.0 6.0,70.0 6.0,70.0 ',n,',5.0 ',n) END AS quad
       FROM (SELECT event_id, CAST(CAST(event_id%50 AS DOUBLE) AS VARCHAR) AS n, CAST(CAST(event_id%50+2 AS DOUBLE) AS VARCHAR) AS m FROM ocr_items) s""",
)
def _(t):
    read = O.read_tree(dealt(t("ocr_items"), "event_id"), KEY, [O.ITEM_POINTS], "item").where("no = 0")
    return read.select("event_id", O.quad_text(F.col("quad")).alias("quad"))


@query(
    "ocr_envelope",
    """SELECT event_id, CASE WHEN event_id%6=5 THEN 'business_error' ELSE 'ok' END AS status, CASE event_id%6 WHEN 0 THEN '10000' WHEN 5 THEN '50000' END AS code,
       CASE event_id%6 WHEN 0 THEN concat('r', CAST(event_id AS VARCHAR)) WHEN 2 THEN concat('m', CAST(event_id AS VARCHAR)) END AS request_id FROM ocr_responses""",
)
def _(t):
    return O.open_envelopes(answers(t)).select("event_id", "status", "code", "request_id")


@query("request_id", "SELECT event_id, CASE event_id%6 WHEN 0 THEN concat('r', CAST(event_id AS VARCHAR)) WHEN 2 THEN concat('m', CAST(event_id AS VARCHAR)) END AS request_id FROM ocr_responses")
def _(t):
    return t("ocr_responses").select("event_id", O.request_id(F.try_parse_json("resp")).alias("request_id"))


@query("json_unwrap", "SELECT event_id, CASE event_id%6 WHEN 2 THEN event_type END AS text, CASE event_id%6 WHEN 2 THEN 'object' WHEN 4 THEN 'list' ELSE 'none' END AS shape FROM events")
def _(t):
    v = F.try_parse_json("resp")
    layered = t("ocr_responses").select("event_id", O.unwrap(F.coalesce(O.member(v, "Result.Output"), O.member(v, "data.detail"))).alias("u"))
    u = F.col("u")
    shape = F.when(O.is_object(u), "object").when(O.is_array(u), "list").otherwise("none")
    return layered.select("event_id", F.try_variant_get(u, "$.texts[0].Content", "string").alias("text"), shape.alias("shape"))


@query(
    "ocr_general_boxes",
    """SELECT event_id, event_type AS text, CASE event_id%6 WHEN 0 THEN concat(n,' 2.0,60.0 2.0,60.0 40.0,',n,' 40.0') WHEN 1 THEN '1.0 2.0,30.0 2.0,30.0 9.0,1.0 9.0' WHEN 2 THEN '1.0 2.0,3.0 2.0,3.0 4.0,1.0 4.0' WHEN 3 THEN '5.0 6.0,70.0 6.0,70.0 80.0,5.0 80.0' ELSE '1.0 2.0,9.0 2.0,9.0 8.0,1.0 8.0' END AS quad,
       CASE event_id%6 WHEN 0 THEN CAST(event_id%100 AS DOUBLE) WHEN 1 THEN 0.5e0 WHEN 4 THEN 0.9e0 END AS confidence FROM (SELECT *, CAST(CAST(event_id%50 AS DOUBLE) AS VARCHAR) AS n FROM events) s WHERE event_id%6<5
       UNION ALL SELECT event_id, 'x', '1.0 1.0,2.0 1.0,2.0 2.0,1.0 2.0', NULL FROM events WHERE event_id%6=1""",
)
def _(t):
    opened = O.open_envelopes(answers(t)).where("status = 'ok'")
    return O.general_boxes(opened, KEY).select("event_id", "text", O.quad_text(F.col("quad")).alias("quad"), "confidence")


@query(
    "ocr_lang_filter",
    """SELECT event_id, event_type AS text FROM events WHERE event_id%6 IN (0,2,3,4) UNION ALL SELECT event_id, 'x' FROM events WHERE event_id%6=1""",
)
def _(t):
    opened = O.open_envelopes(answers(t)).where("status = 'ok'")
    return O.general_boxes(opened, KEY, lang="zh").select("event_id", "text")


@query("ocr_box_dedup", "SELECT event_id, text, quad, confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id, text, quad ORDER BY event_id) AS r FROM (SELECT user_id, event_id, event_type AS text, concat('q', CAST(event_id%3 AS VARCHAR)) AS quad, value AS confidence FROM events) s) d WHERE r=1")
def _(t):
    boxes = t("events").select("user_id", "event_id", F.col("event_type").alias("text"), F.concat(F.lit("q"), F.col("event_id") % 3).alias("quad"), F.col("value").alias("confidence"))
    first = boxes.groupBy("user_id", "text", "quad").agg(F.min(F.struct("event_id", "confidence")).alias("f"))
    return first.select("f.event_id", "text", "quad", "f.confidence")


def _quoted(*pairs: tuple[str, str]) -> str:
    """SQL for a JSON object of strings; a value is SQL."""
    return "concat('{', " + ", ',', ".join(f"'\"{k}\":\"', {v}, '\"'" for k, v in pairs) + ", '}')"


ET = "event_type"
LEAVES = [
    (0, 1, 0, "ocr_infos", _quoted(("lang", "'zh'"), ("text", ET), ("prob", "CAST(event_id%100 AS VARCHAR)"))),
    (1, 1, 0, "ocr_infos", _quoted(("lang", "'ko'"), ("content", ET), ("confidence", "'0.5'"))),
    (1, 2, 0, "ocr_infos", _quoted(("lang", "'en'"), ("text", "'x'"))),
    (2, 1, 0, "texts", _quoted(("Content", ET))),
    (3, 1, 0, "items", _quoted(("block_content", ET))),
    (4, 1, 0, "detail", "'{}'"),
    (4, 2, 1, "textblocks", _quoted(("text", ET), ("x0", "'1'"), ("y0", "'2'"), ("x1", "'9'"), ("y1", "'8'"), ("score", "'0.9'"))),
]


@query(
    "json_nodes",
    "SELECT event_id, CAST(0 AS INT) AS no, CAST(-1 AS INT) AS parent, '' AS key, false AS is_item, '{}' AS scalars FROM events WHERE event_id%6<5"
    + "".join(f" UNION ALL SELECT event_id, CAST({no} AS INT), CAST({parent} AS INT), '{key}', true, {text} FROM events WHERE event_id%6={shape}" for shape, no, parent, key, text in LEAVES),
)
def _(t):
    opened = O.open_envelopes(answers(t)).where("status = 'ok'")
    return O.json_nodes(opened, KEY).withColumn("scalars", F.to_json("scalars"))


FIELDS = [(0, "lang", "'zh'"), (0, "text", ET), (1, "lang", "'ko'"), (1, "content", ET), (1, "confidence", "'0.5'"), (2, "Content", ET), (3, "block_content", ET), (4, "text", ET)]


@query(
    "ocr_license_fields",
    " UNION ALL ".join(f"SELECT event_id, '{field}' AS field, {text} AS text, CAST(NULL AS DOUBLE) AS confidence FROM events WHERE event_id%6={shape}" for shape, field, text in FIELDS),
)
def _(t):
    opened = O.open_envelopes(answers(t)).where("status = 'ok'")
    return O.license_fields(opened, KEY).select("event_id", "field", "text", "confidence")


@query("ocr_numbering", "SELECT doc_id, line_no, printf('ocr_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY line_no)) AS text_id FROM lines WHERE trim(line)<>''")
def _(t):
    numbered = row_numbers(t("lines"), ["doc_id"], [F.col("line_no")], name="no")
    return numbered.where(F.trim("line") != "").select("doc_id", "line_no", F.format_string("ocr_%03d", "no").alias("text_id"))


# All given addresses, and further ones of two more shapes.
URIS = "uris AS (SELECT page_id, 0 AS made, url AS uri FROM pages UNION ALL SELECT page_id, 1+CAST(page_id%2 AS INT), CASE page_id%2 WHEN 0 THEN concat(' /tos-cn-i-abc/img', CAST(page_id AS VARCHAR), '.png?x=1#y ') ELSE concat('https://h.example/tos-a-i-b', CAST(page_id AS VARCHAR), '/k/', CAST(page_id AS VARCHAR), '.pdf') END AS uri FROM pages)"


def uris(t):
    page = F.col("page_id")
    shaped = F.when(page % 2 == 0, F.concat(F.lit(" /tos-cn-i-abc/img"), page, F.lit(".png?x=1#y ")))
    shaped = shaped.otherwise(F.concat(F.lit("https://h.example/tos-a-i-b"), page, F.lit("/k/"), page, F.lit(".pdf")))
    given = t("pages").select("page_id", F.lit(0).alias("made"), F.col("url").alias("uri"))
    return given.unionByName(t("pages").select("page_id", (1 + page % 2).cast("int").alias("made"), shaped.alias("uri")))


@query("object_key", rf"""WITH {URIS} SELECT page_id, made, CASE made WHEN 0 THEN nullif(ltrim(regexp_extract(uri, '^https?://[^/?#]*([^?#]*)', 1), '/'), '') WHEN 1 THEN concat('img', CAST(page_id AS VARCHAR), '.png') ELSE concat('k/', CAST(page_id AS VARCHAR), '.pdf') END AS object_key FROM uris""")
def _(t):
    return uris(t).select("page_id", "made", O.object_key(F.col("uri")).alias("object_key"))


@query("first_uri", "SELECT page_id, CASE WHEN page_id%8=7 THEN NULL ELSE concat('u', CAST(page_id AS VARCHAR)) END AS uri FROM pages")
def _(t):
    u = F.concat(F.lit('"u'), F.col("page_id"), F.lit('"'))
    resp = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('{"Result":{"UriList":[" ",'), u, F.lit("]}}"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit('{"Uri":" ","Results":[{"StoreUri":'), u, F.lit("}]}")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('{"Result":{"ImageUri":'), u, F.lit('},"Uri":"other"}')))
        .when(F.col("page_id") % 8 == 3, F.concat(F.lit('{"Result":{"z":{"myUris":[" ",'), u, F.lit(']}},"a":{"uri2":"late"}}'))).otherwise(F.lit('{"Result":{}}'))
    )
    return O.find_uris(t("pages").select("page_id", resp.alias("resp")), ["page_id"])


@query("source_route", f"""WITH {URIS}, asks AS (SELECT page_id, CASE page_id%5 WHEN 0 THEN 'file' WHEN 1 THEN 'url' ELSE 'uri' END AS dt, trim(uri) AS s, page_id%4=1 AS known FROM uris),
 sent AS (SELECT *, CASE WHEN dt='file' THEN CASE WHEN known THEN 'file' ELSE 'error' END WHEN dt='url' THEN CASE WHEN s LIKE 'http%' THEN 'url' ELSE 'error' END WHEN known THEN 'file' ELSE 'url' END AS how FROM asks),
 adr AS (SELECT *, CASE WHEN how='url' THEN CASE WHEN s LIKE 'http%' THEN s ELSE concat('https://cdn.example/', ltrim(s,'/')) END WHEN how='file' THEN s END AS address FROM sent)
 SELECT page_id, how, address, CASE WHEN lower(CASE WHEN how='url' THEN regexp_extract(address, '^https?://[^/?#]*([^?#]*)', 1) ELSE coalesce(address,'') END) LIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS file_kind FROM adr""")
def _(t):
    page = F.col("page_id")
    kind = F.when(page % 5 == 0, "file").when(page % 5 == 1, "url").otherwise("uri")
    asks = uris(t).select("page_id", kind.alias("dt"), F.trim("uri").alias("s"), (page % 4 == 1).alias("known"))
    how, address, file_kind = E.route(F.col("dt"), F.col("s"), F.col("known"), "cdn.example")
    return asks.select("page_id", how.alias("how"), address.alias("address"), file_kind.alias("file_kind"))


@query("payload_budget", "SELECT doc_id, line_no, CAST(length(url_encode(base64(encode(line)))) AS INT) AS size, length(url_encode(base64(encode(line))))<=400 AS fits FROM lines")
def _(t):
    sized = t("lines").withColumn("size", E.encoded_size(F.encode(F.col("line"), "utf-8")))
    return sized.select("doc_id", "line_no", "size", (F.col("size") <= 400).alias("fits"))


ERRORS = """errs AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'ValueError' WHEN 'view' THEN 'ReadTimeout' ELSE 'RuntimeError' END AS kind, CASE WHEN event_type='click' THEN CAST(400+event_id%200 AS INT) END AS status,
 CASE event_id%6 WHEN 0 THEN 'Bad Gateway upstream' WHEN 1 THEN 'request NOT FOUND' WHEN 2 THEN 'code 503 again' WHEN 3 THEN 'http status=413' WHEN 4 THEN concat('plain', chr(10), repeat('long ', CAST(event_id%90 AS INT))) ELSE 'Timed out' END AS message FROM events)"""


def error_log(t):
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "error", "ValueError").when(F.col("event_type") == "view", "ReadTimeout").otherwise("RuntimeError")
    long = F.concat(F.lit("plain\n"), F.expr("repeat('long ', cast(event_id % 90 as int))"))
    message = F.when(e % 6 == 0, "Bad Gateway upstream").when(e % 6 == 1, "request NOT FOUND").when(e % 6 == 2, "code 503 again").when(e % 6 == 3, "http status=413").when(e % 6 == 4, long).otherwise("Timed out")
    return t("events").select("event_id", kind.alias("kind"), F.when(F.col("event_type") == "click", (400 + e % 200).cast("int")).alias("status"), message.alias("message"))


@query("error_retryable", f"WITH {ERRORS} SELECT event_id, CASE WHEN kind='ValueError' THEN false WHEN status BETWEEN 500 AND 599 THEN true WHEN status BETWEEN 400 AND 499 THEN false WHEN kind='ReadTimeout' THEN true ELSE event_id%6 IN (0,2,5) END AS retryable, kind<>'ValueError' AS retryable_step FROM errs")
def _(t):
    return error_log(t).select("event_id", E.retryable(F.col("kind"), F.col("status"), F.col("message")).alias("retryable"), E.retryable_step(F.col("kind")).alias("retryable_step"))


@query("payload_limit_error", f"WITH {ERRORS} SELECT event_id, event_id%6=3 AS over_limit FROM errs")
def _(t):
    return error_log(t).select("event_id", E.payload_limit(F.col("message")).alias("over_limit"))


@query("summarize_error", f"WITH {ERRORS}, one AS (SELECT event_id, trim(replace(concat(kind,': ',message),chr(10),' ')) AS s FROM errs) SELECT event_id, CASE WHEN length(s)>240 THEN concat(substr(s,1,240),'...') ELSE s END AS summary FROM one")
def _(t):
    return error_log(t).select("event_id", E.summarize(F.col("kind"), F.col("message")).alias("summary"))


@query("backoff_schedule", "SELECT event_id, CAST(a AS INT) AS attempt, least(0.5e0*power(2e0,a-1),4e0) AS wait, least(1e0*power(2e0,a-1),8e0) AS step_wait FROM (SELECT event_id, unnest(range(1,2+event_id%6)) AS a FROM events) s")
def _(t):
    tried = t("events").select("event_id", F.explode(F.sequence(F.lit(1), (1 + F.col("event_id") % 6).cast("int"))).alias("attempt"))
    return tried.select("event_id", "attempt", E.backoff(F.col("attempt")).alias("wait"), E.backoff(F.col("attempt"), 1.0, 2.0, 8.0).alias("step_wait"))


NAME = "CASE p_size%6 WHEN 0 THEN '' WHEN 1 THEN concat('EP-', p_name) WHEN 2 THEN concat('doubao-seed-1-8-', p_brand) WHEN 3 THEN concat('Doubao 1.8 ', p_type) WHEN 4 THEN concat('doubao-seed ', p_name) ELSE p_name END"


@query("model_name_check", "SELECT p_partkey, p_size%6 IN (1,2,3) AS allowed FROM part")
def _(t):
    size = F.col("p_size") % 6
    name = (
        F.when(size == 0, F.lit("")).when(size == 1, F.concat(F.lit("EP-"), "p_name")).when(size == 2, F.concat(F.lit("doubao-seed-1-8-"), "p_brand"))
        .when(size == 3, F.concat(F.lit("Doubao 1.8 "), "p_type")).when(size == 4, F.concat(F.lit("doubao-seed "), "p_name")).otherwise(F.col("p_name"))
    )
    return t("part").select("p_partkey", E.model_allowed(name).alias("allowed"))


@query("enum_validate", "SELECT page_id, CASE WHEN page_id%3=0 THEN 'ok' ELSE 'bad scene' END AS scene, CASE WHEN lang IN ('zh','ko') THEN 'ok' WHEN lang='' THEN 'blank' ELSE 'bad language' END AS language, CASE WHEN page_id%2=0 THEN 'ok' ELSE 'bad endpoint' END AS endpoint, CASE WHEN page_id%5<3 THEN 'ok' ELSE 'bad data_type' END AS data_type, CASE WHEN page_id%4<2 THEN 'ok' ELSE 'bad url' END AS url FROM (SELECT doc_id AS page_id, CASE WHEN doc_id%4=0 THEN '' WHEN doc_id%4=1 THEN 'zh' ELSE lang END AS lang FROM documents) s")
def _(t):
    d = F.col("doc_id")
    lang = F.when(d % 4 == 0, " ").when(d % 4 == 1, " ZH").otherwise(F.col("lang"))
    return t("documents").select(
        d.alias("page_id"), E.validate(F.when(d % 3 == 0, " General ").otherwise("poster"), "scene").alias("scene"), E.validate(lang, "language").alias("language"),
        E.validate(F.when(d % 2 == 0, "PDF").otherwise(""), "endpoint").alias("endpoint"),
        E.validate(F.when(d % 5 == 0, " URL ").when(d % 5 == 1, "uri").when(d % 5 == 2, "File").when(d % 5 == 3, "path"), "data_type").alias("data_type"),
        E.validate(F.when(d % 4 == 0, F.concat(F.lit(" HTTPS://h/"), d)).when(d % 4 == 1, "http://x").when(d % 4 == 2, "ftp://x"), "url").alias("url"),
    )
