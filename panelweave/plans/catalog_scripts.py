"""Dialogue selection, prompt and script queries, and model callables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import ocr_json as O
from panelweave.operators import patches as P
from panelweave.operators import scripts as S
from panelweave.plans.catalog_patches import CROPS, GRAY, crops
from panelweave.plans.registry import query
from panelweave.session import cut_lineage, shared_folder

PANEL = ["panel_id"]
# All texts of all conversations, and further blank ones.
ROWS = "rows_ AS (SELECT conv_id AS panel_id, turn*2 AS reading_no, conv_id*1000000+turn*2 AS text_id, text FROM conversations UNION ALL SELECT conv_id, turn*2+1, conv_id*1000000+turn*2+1, '  ' FROM conversations WHERE (conv_id+turn)%5=0)"


def dialogue(t):
    given = t("conversations")

    def rows(df, late, text):
        place = F.col("turn") * 2 + late
        return df.select(F.col("conv_id").alias("panel_id"), place.alias("reading_no"), (F.col("conv_id") * 1000000 + place).alias("text_id"), text.alias("text"))

    return rows(given, 0, F.col("text")).unionByName(rows(given.where("(conv_id + turn) % 5 = 0"), 1, F.lit("  ")))


@query("select_texts", f"WITH {ROWS} SELECT panel_id, text_id, text FROM rows_ WHERE text_id IN (1000000,3000004,5000002) OR contains(trim(text),'eauou') OR contains(trim(text),'zu')")
def _(t):
    return S.select_texts(dialogue(t), ["1000000", " 3000004 ", "5000002", ""], ["eauou", " ", " zu "]).select("panel_id", "text_id", "text")


@query("bound_texts", f"WITH {ROWS}, bound AS (SELECT o_custkey AS panel_id, o_custkey*1000000+o_orderkey%4*2 AS text_id FROM orders WHERE o_orderstatus='P') SELECT panel_id, text_id FROM rows_ r WHERE (panel_id, text_id) IN (SELECT panel_id, text_id FROM bound) OR panel_id NOT IN (SELECT panel_id FROM bound)")
def _(t):
    bindings = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("panel_id"), (F.col("o_custkey") * 1000000 + F.col("o_orderkey") % 4 * 2).alias("text_id"))
    return S.bound_texts(dialogue(t), bindings, PANEL).select("panel_id", "text_id")


def _sql_text(template):
    return "concat(" + ", chr(10), ".join("'" + line + "'" for line in template.split("\n")) + ")"


def _filled(template, lines, goal):
    return f"replace(replace({_sql_text(template)}, '{{goal}}', '{goal}'), '{{lines}}', {lines})"


SPOKEN = rf"spoken AS (SELECT *, regexp_replace(text,'^\s+|\s+$','','g') AS s, row_number() OVER (PARTITION BY panel_id ORDER BY reading_no) AS i FROM rows_)"
NUMBERED = "coalesce(string_agg(concat(CAST(i AS VARCHAR),'. ',s), chr(10) ORDER BY reading_no) FILTER (WHERE s<>''),'" + S.NO_TEXT + "')"
UNKNOWN = "coalesce(string_agg(concat('《未知角色',CAST(j AS VARCHAR),'》：',s), chr(10) ORDER BY reading_no) FILTER (WHERE s<>''),'" + S.NO_TEXT + "')"
SCRIPT = f"script_ AS (SELECT panel_id, {_filled(S.FALLBACK, UNKNOWN, '无')} AS script_text FROM (SELECT *, sum(CASE WHEN s<>'' THEN 1 ELSE 0 END) OVER (PARTITION BY panel_id ORDER BY reading_no) AS j FROM spoken) k GROUP BY 1)"


@query("prompt_build", f"WITH {ROWS}, {SPOKEN} SELECT panel_id, {_filled(S.PROMPT, NUMBERED, S.DEFAULT_GOAL)} AS prompt FROM spoken GROUP BY 1")
def _(t):
    return S.build_prompts(dialogue(t), PANEL)


@query("script_fallback", f"WITH {ROWS}, {SPOKEN}, {SCRIPT} SELECT panel_id, script_text FROM script_")
def _(t):
    return S.fallback_scripts(dialogue(t), PANEL)


@query("batch_generate", f"WITH {ROWS}, {SPOKEN}, {SCRIPT} SELECT panel_id, script_text, 'local_fallback' AS backend, 'init: no model' AS reason FROM script_")
def _(t):
    return S.generate_scripts(dialogue(t), PANEL)


@query("panel_script_payload", f"WITH {ROWS}, {SPOKEN}, {SCRIPT} SELECT panel_id, script_text AS markdown FROM script_")
def _(t):
    scripts = S.generate_scripts(dialogue(t), PANEL).withColumn("script_markdown", F.lit(" "))
    return S.script_payloads(scripts).select("panel_id", "markdown")


ANSWERS = "CASE event_id%5 WHEN 0 THEN concat('```json', chr(10), '{\"k\":\"', event_type, '\"}', chr(10), '```') WHEN 1 THEN concat(' {\"k\":\"', event_type, '\"} ') WHEN 2 THEN concat('so: {\"k\":\"', event_type, '\"} done') WHEN 3 THEN '[1,2]' ELSE event_type END"


@query("json_from_text", "SELECT event_id, CASE WHEN event_id%5<3 THEN event_type END AS k FROM events")
def _(t):
    answers = t("events").select("event_id", F.expr(ANSWERS).alias("answer"))
    return answers.select("event_id", F.try_variant_get(O.json_from_text(F.col("answer")), "$.k", "string").alias("k"))


CONTENT = "CASE event_id%3 WHEN 0 THEN concat('\"', event_type, '\"') WHEN 1 THEN concat('[\"a\",{\"text\":\"', event_type, '\"},{\"image\":\"z\"},{\"text\":5}]') ELSE '[]' END"


@query("flatten_content", "SELECT event_id, CASE event_id%3 WHEN 0 THEN event_type WHEN 1 THEN concat('a', chr(10), event_type) ELSE '' END AS content FROM events")
def _(t):
    return t("events").select("event_id", O.flatten_content(F.try_parse_json(F.expr(CONTENT))).alias("content"))


@query(
    "batch_embed",
    f"""WITH {GRAY}, {CROPS}, keyed AS (SELECT image_id, node_id, sha1(unhex(concat(hex(concat('local:', printf('(%d, %d, 3)', max(y)-min(y)+1, max(x)-min(x)+1))), string_agg(concat(lpad(printf('%X', b),2,'0'), lpad(printf('%X', g),2,'0'), lpad(printf('%X', r),2,'0')), '' ORDER BY y, x)))) AS content_key FROM crops GROUP BY 1,2)
    SELECT content_key, CASE WHEN bool_or(image_id%2=0) THEN 'cache' ELSE 'local' END AS backend, CAST(32 AS INT) AS width, 1e0 AS length FROM keyed GROUP BY 1""",
)
def _(t):
    """Vectors of all patches, where those of the images of even number have been stored before.

    Keys are stored once made: every step asks for them, and making them goes through the pixels of all patches.
    """
    keys = ["image_id", "node_id"]
    patches = crops(t)
    keyed = cut_lineage(P.content_keys(patches, keys, "local:"))
    store = shared_folder(t.spark, "patch-vectors")

    def local(missing):
        chosen = missing.select("content_key", *keys)
        return P.histogram_embedding(patches.join(chosen.select(*keys), keys, "left_semi"), keys).join(chosen, keys)

    S.embed_through_store(keyed.where("image_id % 2 = 0"), store, local=local)
    vectors = S.embed_through_store(keyed, store, local=local)
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x))
    return vectors.select("content_key", "backend", F.size("embedding").alias("width"), F.round(size, 6).alias("length"))
