"""Selecting dialogue of a panel and turning it into a prompt or a script."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.text import strip
from panelweave.session import cut_lineage

# Wording of prompts and of the script made without a model.
NO_TEXT = "(无文字)"
DEFAULT_GOAL = "保留原文语义并增强戏剧性"
PROMPT = """请根据条漫分镜画面和以下文字，生成单格分镜脚本。
用户目标：{goal}

## 选中文字
{lines}

## 输出格式
请按以下结构输出纯文本（Markdown），不要输出 JSON：

**【画面信息】**
- 景别 / 构图：
- 角色：
- 场景 / 氛围：
- 镜头运动：

**【对话 / 台词】**
（按角色绑定，格式：《角色特征》：文字内容）

**【导演指令】**
- 动作 / 表情：
- 情绪节奏：
- 声音：
"""
FALLBACK = """**【画面信息】**
- 景别 / 构图：中景
- 角色：【不确定·无图像分析】
- 场景 / 氛围：【不确定】
- 镜头运动：【不确定】

**【对话 / 台词】**
{lines}

**【导演指令】**
- 动作 / 表情：角色保持叙述姿态
- 情绪节奏：克制中的紧张 | 用户目标：{goal}
- 声音：背景截断居"""


def select_texts(rows: DataFrame, ids: Sequence[str] = (), fragments: Sequence[str] = ()) -> DataFrame:
    """Rows with a wanted id, or holding a wanted fragment; all rows if nothing is wanted."""
    ids = [i.strip() for i in map(str, ids) if i.strip()]
    fragments = [f.strip() for f in map(str, fragments) if f.strip()]
    if not ids and not fragments:
        return rows
    wanted = F.trim(F.col("text_id").cast("string")).isin(*ids) if ids else F.lit(False)
    text = strip(F.coalesce("text", F.lit("")))
    for fragment in fragments:
        wanted = wanted | F.contains(text, F.lit(fragment))
    return rows.where(wanted)


def bound_texts(rows: DataFrame, bindings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts a panel is bound to; all of them for a panel without binding."""
    marks = bindings.select(*keys, "text_id").distinct().withColumn("_mine", F.lit(True))
    bound = bindings.select(*keys).distinct().withColumn("_bound", F.lit(True))
    joined = rows.join(marks, [*keys, "text_id"], "left").join(bound, [*keys], "left")
    return joined.where("_mine OR _bound IS NULL").drop("_mine", "_bound")


def _dialogue(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Texts of each panel in order.  A panel's dialogue is what one prompt can hold."""
    item = F.struct("reading_no", strip(F.coalesce("text", F.lit(""))).alias("text"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _filled(template: str, lines: Column, goal: Column) -> Column:
    head, rest = template.split("{goal}") if template.index("{goal}") < template.index("{lines}") else template.split("{lines}")
    first, second = (goal, lines) if "{lines}" in rest else (lines, goal)
    middle, tail = rest.split("{lines}" if "{lines}" in rest else "{goal}")
    return F.concat(F.lit(head), first, F.lit(middle), second, F.lit(tail))


def _or(text: Column, default: str) -> Column:
    return F.when(text == "", F.lit(default)).otherwise(text)


def build_prompts(rows: DataFrame, keys: Sequence[str], goal: str = "") -> DataFrame:
    """Prompt per panel: its non-blank texts, numbered by their place among all of them."""
    numbered = F.transform("items", lambda r, i: F.when(r["text"] != "", F.concat((i + 1).cast("string"), F.lit(". "), r["text"])))
    lines = F.array_join(F.filter(numbered, lambda t: t.isNotNull()), "\n")
    return _dialogue(rows, keys).select(*keys, _filled(PROMPT, _or(lines, NO_TEXT), F.lit(goal or DEFAULT_GOAL)).alias("prompt"))


def fallback_scripts(rows: DataFrame, keys: Sequence[str], goal: str = "") -> DataFrame:
    """Script per panel without a model: its non-blank texts, each to an unknown speaker."""
    spoken = F.filter("items", lambda r: r["text"] != "")
    lines = F.array_join(F.transform(spoken, lambda r, i: F.concat(F.lit("《未知角色"), (i + 1).cast("string"), F.lit("》："), r["text"])), "\n")
    return _dialogue(rows, keys).select(*keys, _filled(FALLBACK, _or(lines, NO_TEXT), F.lit(goal or "无")).alias("script_text"))


def generate_scripts(rows: DataFrame, keys: Sequence[str], goal: str = "", modes: dict[str, Callable[[str], str]] | None = None,
                     retries: int = 1, allow_fallback: bool = True) -> DataFrame:
    """Ask the model callables in turn (say ``multimodal``, then ``text_only``); fall back to the plain script.

    Callables run inside tasks, on Arrow batches; a failing answer never stops the job unless ``allow_fallback`` is off.
    """
    modes = modes or {}
    asked = build_prompts(rows, keys, goal).join(fallback_scripts(rows, keys, goal), [*keys])

    def one(prompt: str) -> tuple[str | None, str, str]:
        failures = [] if modes else ["init: no model"]
        for name, call in modes.items():
            for attempt in range(1, max(1, retries) + 1):
                try:
                    return call(prompt).strip(), name, ""
                except Exception as exc:
                    failures.append(f"{name}#{attempt}: {type(exc).__name__}: {exc}")
        if not allow_fallback:
            raise RuntimeError("no script from any model: " + "; ".join(failures))
        return None, "local_fallback", "; ".join(failures)

    def answer(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            replies = pd.DataFrame([one(p) for p in batch["prompt"]], columns=["reply", "backend", "reason"], index=batch.index)
            yield batch.assign(
                script_text=replies["reply"].where(replies["reply"].notna(), batch["script_text"]), backend=replies["backend"], reason=replies["reason"]
            ).drop(columns="prompt")

    schema = asked.drop("prompt").withColumns({"backend": F.lit(""), "reason": F.lit("")}).schema
    return asked.mapInPandas(answer, schema)


def embed_batch(wanted: DataFrame, call: Callable[[pd.DataFrame], list], column: str = "embedding") -> DataFrame:
    """Add vectors from a callable that gets one Arrow batch at a time."""
    schema = wanted.withColumn(column, F.array(F.lit(0.0))).schema

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{column: call(batch)})

    return wanted.mapInPandas(run, schema)


def stored_vectors(spark: SparkSession, store: str) -> DataFrame:
    """(content_key, embedding, backend, batch) of a vector store; no rows where nothing has been stored yet."""
    schema = "content_key string, embedding array<double>, backend string, batch int"
    try:
        return spark.read.schema(schema).parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.range(0).selectExpr(*("CAST(NULL AS {1}) AS {0}".format(*c.split()) for c in schema.split(", ")))


def embed_through_store(inputs: DataFrame, store: str, models: dict[str, Callable[[pd.DataFrame], list]] | None = None,
                        local: Callable[[DataFrame], DataFrame] | None = None, retries: int = 3, wait: float = 0.4,
                        batch_rows: int = 64) -> DataFrame:
    """(content_key, embedding, backend), one row per key of ``inputs``: from the store, else a model, else ``local``.

    Only keys the store lacks are computed, once each, and are then added to it as a batch of their own, so a second run
    computes nothing. ``models`` are tried in turn on up to ``batch_rows`` rows of ``inputs``, each ``retries`` times
    with a growing pause; a model must give a vector for every row, which is brought to unit length. ``local`` turns the
    rows no model answered into (content_key, embedding); without it (strict mode) they end the job. ``backend`` is the
    model's name or ``local``, and ``cache`` for what the store had. Rows with a null key are left out.
    One run at a time may write to a store; what a broken run left behind has no rows and is filled by the next.
    """
    models = models or {}
    if not models and local is None:
        raise ValueError("no model, and no local fallback either")
    spark = inputs.sparkSession
    stored = stored_vectors(spark, store)
    number = (stored.agg(F.max("batch")).first()[0] or 0) + 1
    known = stored.where(F.col("batch") < number)
    keys = inputs.where(F.col("content_key").isNotNull())
    missing = keys.join(known.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"])

    def one(rows: pd.DataFrame) -> tuple[list, str | None, str]:
        failures = []
        for name, call in models.items():
            for attempt in range(1, max(1, retries) + 1):
                try:
                    vectors = np.array(call(rows), dtype=float)
                    if vectors.ndim != 2 or len(vectors) != len(rows):
                        raise ValueError(f"{len(rows)} vectors of one length wanted, shape {vectors.shape} given")
                    sizes = np.linalg.norm(vectors, axis=1, keepdims=True)
                    return (vectors / np.where(sizes > 1e-8, sizes, 1.0)).tolist(), name, ""
                except Exception as exc:
                    failures.append(f"{name}#{attempt}: {type(exc).__name__}: {exc}")
                    if attempt < retries:
                        time.sleep(wait * attempt)
        if local is None:
            raise RuntimeError("no vector from any model: " + "; ".join(failures))
        return [None] * len(rows), None, "; ".join(failures)

    def ask(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_rows):
                rows = batch.iloc[start : start + batch_rows]
                vectors, backend, reason = one(rows)
                yield pd.DataFrame({"content_key": rows["content_key"].to_numpy(), "embedding": vectors, "backend": backend, "reason": reason})

    if models:
        made = cut_lineage(missing.mapInPandas(ask, "content_key string, embedding array<double>, backend string, reason string"))
        left = missing.join(made.where(F.col("backend").isNull()).select("content_key"), "content_key", "left_semi")
        made = made.where(F.col("backend").isNotNull()).select("content_key", "embedding", "backend")
    else:
        made, left = None, missing
    if local is not None:
        plain = local(left).select("content_key", "embedding", F.lit("local").alias("backend"))
        made = plain if made is None else made.unionByName(plain)
    made.write.mode("append").parquet(f"{store}/batch={number}")
    asked = keys.select("content_key").distinct()
    now = stored_vectors(spark, store).where(F.col("batch") <= number)
    backend = F.when(F.col("batch") < number, F.lit("cache")).otherwise(F.col("backend"))
    return now.join(asked, "content_key", "left_semi").select("content_key", "embedding", backend.alias("backend"))


def script_payloads(scripts: DataFrame) -> DataFrame:
    """JSON record and Markdown of each script; a blank Markdown falls back to the script's text."""
    record = F.to_json(F.struct("panel_id", "script_text", "backend"))
    markdown = F.coalesce(F.when(F.trim(F.coalesce("script_markdown", F.lit(""))) != "", F.col("script_markdown")), F.col("script_text"))
    return scripts.select("panel_id", record.alias("json"), markdown.alias("markdown"))
