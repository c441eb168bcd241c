"""Reading OCR answers of many shapes: envelopes, item fields and the tree walk.

Single items and envelopes are read with variant functions. A whole tree, whose
key order matters, is walked once in Arrow batches, which gives every object's
fields as typed columns; choosing among them is left to joins and grouping.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from panelweave.session import cut_lineage

# The names under which services put the same thing.
TEXT_KEYS = ("Content", "content", "Text", "text", "Value", "value", "Word", "word", "Words", "words", "OCRText", "ocrText", "block_content", "block_text")
CONFIDENCE_KEYS = ("Confidence", "confidence", "Score", "score", "Probability", "probability", "prob")
QUAD_KEYS = ("Location", "location", "Quad", "quad", "Polygon", "polygon", "Points", "points", "BBox", "bbox", "Box", "box",
             "block_bbox", "block_polygon_points", "coordinate", "coordinates", "Rect", "rect")
NESTED_QUAD_KEYS = ("points", "Points", "polygon", "Polygon", "quad", "Quad", "bbox", "BBox")
FIELD_QUAD_KEYS = QUAD_KEYS[:8]
CORNERS = (("LeftTop", "leftTop", "left_top"), ("RightTop", "rightTop", "right_top"), ("RightBottom", "rightBottom", "right_bottom"), ("LeftBottom", "leftBottom", "left_bottom"))
LIST_KEYS = ("texts", "textlist", "textsinfo", "generalinfo", "items", "lines", "ocrtexts", "textblocks", "ocr_infos")
FIELD_CONTAINERS = ("Fields", "FieldMap", "LicenseInfo", "LicenseFields", "Data", "Result")
FIELD_NAMES = ("Name", "Field", "Key", "Label", "Title")
REQUEST_ID_PATHS = ("ResponseMetadata.RequestId", "ResponseMetadata.RequestID", "Metadata.RequestId", "RequestId", "RequestID", "request_id")
URI_KEYS = ("Uri", "URI", "ImageUri", "ResourceUri", "StoreUri", "StoreKey")
URI_LIST_KEYS = ("UriList", "ImageUriList", "ImageURLList", "StoreUriList", "StoreKeyList", "StoreKeys", "Results")

#: Objects told at once by the walk.
PIECE = 4096
NUMBER = r"^(BIGINT|DOUBLE|FLOAT|INT|SMALLINT|TINYINT|DECIMAL.*)$"


def member(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def is_number(v: Column) -> Column:
    return kind(v).rlike(NUMBER)


def is_object(v: Column) -> Column:
    return kind(v).startswith("OBJECT")


def is_array(v: Column) -> Column:
    return kind(v).startswith("ARRAY")


def text_of(v: Column) -> Column:
    """The variant as a string, if it is one."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _named(v: Column, build) -> Column:
    """Bind a variant to a name, so that a long expression reads it once."""
    return F.element_at(F.transform(F.array(v), build), 1)


def _members(v: Column, keys) -> Column:
    """Members under each of the names, in their order; null for absent ones."""
    return F.transform(F.array(*(F.lit(f"$.{k}") for k in keys)), lambda path: F.try_variant_get(v, path, "variant"))


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def non_blank(text: Column) -> Column:
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(stripped != "", stripped)


def text_field(item: Column) -> Column:
    """First non-blank text under the known names."""
    return _first(F.transform(_members(item, TEXT_KEYS), lambda v: non_blank(text_of(v))))


def confidence(item: Column) -> Column:
    """First number, or string that reads as one, under the known names."""
    def value(v: Column) -> Column:
        number = F.when(is_number(v) | (kind(v) == "BOOLEAN"), F.try_variant_get(v, "$", "double"))
        return F.coalesce(number, non_blank(text_of(v)).try_cast("double"))

    return _first(F.transform(_members(item, CONFIDENCE_KEYS), value))


def quad_text(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.array_join(p.cast("array<string>"), " ")), ",")


def unwrap(v: Column) -> Column:
    """Decode up to two layers of JSON in a string; null where no object or list results."""
    def once(x: Column) -> Column:
        return F.when(kind(x) == "STRING", F.try_parse_json(text_of(x))).otherwise(x)

    opened = once(once(v))
    return F.when(is_object(opened) | is_array(opened), opened)


def request_id(resp: Column) -> Column:
    found = [F.try_variant_get(resp, f"$.{path}", "string") for path in REQUEST_ID_PATHS]
    return F.coalesce(*(F.when((f != "") & (f != "0") & (f != "false"), f) for f in found))


def _parsed(text: str | None) -> object:
    """What a JSON text says; None if it is none or nested beyond what the parser takes."""
    try:
        return None if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return None


def _as_object(value: object) -> dict | None:
    """An object, a bare list going under ``items``; None for anything else."""
    return {"items": value} if isinstance(value, list) else value if isinstance(value, dict) else None


def _opened(root: dict) -> dict | None:
    """The payload of an answer's envelope: ``Result.Output`` in up to two layers of JSON text, ``data``, or ``result``."""
    result, data = root.get("Result"), root.get("data")
    if isinstance(result, dict):
        found = result.get("Output")
        for _ in range(2):
            found = _parsed(found) if isinstance(found, str) else found
        return _as_object(found)
    if isinstance(data, dict):
        detail = _parsed(data["detail"]) if isinstance(data.get("detail"), str) else None
        return data if detail is None else data | {"detail": detail}
    return _as_object(root.get("result"))


def _request_id(root: dict) -> str | None:
    for path in REQUEST_ID_PATHS:
        value: object = root
        for name in path.split("."):
            value = value.get(name) if isinstance(value, dict) else None
        if value:
            return value if isinstance(value, str) else json.dumps(value)
    return None


def open_envelopes(responses: DataFrame, column: str = "resp") -> DataFrame:
    """Add ``status`` (ok, business_error, invalid), ``code``, ``request_id`` and the ``payload`` as JSON text.

    Members keep their order. An answer that is null or no JSON is invalid. Each is read once, where it lies: deal small
    tables out over the cores before.
    """
    told = ["status", "code", "request_id", "payload"]

    def read(text: str | None) -> tuple[str | None, ...]:
        root = _parsed(text)
        root = root if isinstance(root, dict) else {}
        code = root.get("code")
        code = code if code is None or isinstance(code, str) else json.dumps(code)
        if code not in (None, "10000"):
            return "business_error", code, _request_id(root), None
        payload = _opened(root)
        shown = None if payload is None else json.dumps(payload, ensure_ascii=False, separators=(",", ":"))
        return "invalid" if payload is None else "ok", code, _request_id(root), shown

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                piece = batch.slice(start, PIECE)
                found = zip(*[read(text) for text in piece.column(column).to_pylist()])
                yield pa.RecordBatch.from_arrays([*piece.columns, *[pa.array(v, pa.string()) for v in found]], names=[*piece.schema.names, *told])

    kept = responses.drop(*told)
    return kept.mapInArrow(opened, ", ".join([*[f"`{n}` {kind}" for n, kind in kept.dtypes], *[f"{n} string" for n in told]]))


def keep_language(payload: Column, lang: str | None) -> Column:
    """Drop recognised lines of other languages than ``lang``, ``not_lang`` and ``en``; lines without one stay."""
    if not lang:
        return payload
    fields = F.from_json(payload, "map<string,variant>")
    infos = F.try_variant_get(F.element_at(fields, "ocr_infos"), "$", "array<variant>")

    def fits(line: Column) -> Column:
        named = F.lower(F.trim(F.coalesce(F.try_variant_get(line, "$.lang", "string"), F.lit(""))))
        return is_object(line) & named.isin("", lang, "not_lang", "en")

    kept = F.to_variant_object(F.filter(infos, fits))
    swapped = F.transform_values(fields, lambda k, v: F.when(k == "ocr_infos", kept).otherwise(v))
    return F.when(infos.isNull(), payload).otherwise(F.to_json(swapped))


@dataclass(frozen=True)
class Field:
    """What to read of every object of a tree: a name, the column's Arrow type, and a function of the object."""

    name: str
    kind: pa.DataType
    read: Callable[[dict], object]


def _stripped(value: object) -> str | None:
    return value.strip() or None if isinstance(value, str) else None


def _first_text(item: dict, names: Iterable[str]) -> str | None:
    return next((text for name in names if (text := _stripped(item.get(name)))), None)


def _numbers(values: list[object]) -> list[float] | None:
    """All values as doubles, if all are numbers."""
    try:
        return [float(v) for v in values] if all(isinstance(v, (int, float)) for v in values) else None
    except OverflowError:
        return None


def _named_numbers(item: dict, *names: tuple[str, ...]) -> list[float] | None:
    """A number under the first name present of each of the given alternatives."""
    return _numbers([next((item[k] for k in some if k in item), None) for some in names])


def _corners(x1: float, y1: float, x2: float, y2: float) -> list[list[float]]:
    return [[x1, y1], [x2, y1], [x2, y2], [x1, y2]]


def _edge_box(item: dict) -> list[list[float]] | None:
    edges = _named_numbers(item, ("x0", "left"), ("y0", "top"), ("x1", "right"), ("y1", "bottom"))
    return _corners(*edges) if edges else None


def _listed_points(place: list) -> list[list[float]] | None:
    flat = _numbers(place)
    if flat and len(flat) == 8:
        return [flat[k : k + 2] for k in range(0, 8, 2)]
    if flat and len(flat) == 4:
        return _corners(*flat)
    if len(place) == 4 and all(isinstance(p, list) and len(p) > 1 for p in place):
        try:
            return [[float(p[0]), float(p[1])] for p in place]
        except (TypeError, ValueError, OverflowError):
            return None
    return None


def _place_points(place: object) -> list[list[float]] | None:
    """Points of a place however deep it is nested: named corners, edges, size, a place within, or a list."""
    while isinstance(place, dict):
        named = [next((place[k] for k in some if k in place), None) for some in CORNERS]
        points = [_named_numbers(c, ("X", "x"), ("Y", "y")) if isinstance(c, dict) else None for c in named]
        if all(points):
            return points
        if edges := _edge_box(place):
            return edges
        if sized := _named_numbers(place, ("x",), ("y",), ("width", "w"), ("height", "h")):
            x, y, w, h = sized
            return _corners(x, y, x + w, y + h)
        place = next((place[k] for k in NESTED_QUAD_KEYS if k in place), None)
    return _listed_points(place) if isinstance(place, list) else None


def _item_points(item: dict) -> list[list[float]] | None:
    place = next((item[k] for k in QUAD_KEYS if k in item), None)
    return _edge_box(item) if place is None else _place_points(place)


def _item_confidence(item: dict) -> float | None:
    for value in (item[k] for k in CONFIDENCE_KEYS if k in item):
        try:
            if isinstance(value, (int, float)) or _stripped(value):
                return float(value)
        except (ValueError, OverflowError):
            pass
    return None


def _main_list(item: dict) -> str | None:
    """Name of the object's first list of objects under a known name."""
    return next((k for k, v in item.items() if k.lower() in LIST_KEYS and isinstance(v, list) and all(isinstance(i, dict) for i in v)), None)


def _scalars(item: dict) -> list[tuple[str, str]]:
    """Members that are neither objects, lists nor null: strings as they are, others as JSON."""
    return [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in item.items() if v is not None and not isinstance(v, (dict, list))]


def _address(value: object) -> str | None:
    """An address: a text, or the first text in a list or under a known name of its objects."""
    if isinstance(value, list):
        return next((u for v in value if (u := _first_text(v, URI_KEYS) if isinstance(v, dict) else _stripped(v))), None)
    return _stripped(value)


DOUBLES = pa.list_(pa.list_(pa.float64()))
TEXT = Field("text", pa.string(), lambda o: _first_text(o, TEXT_KEYS))
CONFIDENCE = Field("confidence", pa.float64(), lambda o: _item_confidence(o) if _first_text(o, TEXT_KEYS) else None)
POINTS = Field("quad", DOUBLES, lambda o: _item_points(o) if _first_text(o, TEXT_KEYS) else None)
#: Points whether or not there is a text.
ITEM_POINTS = Field("quad", DOUBLES, _item_points)
MAIN_LIST = Field("main_list", pa.string(), _main_list)
NAME = Field("name", pa.string(), lambda o: _first_text(o, FIELD_NAMES))
PLACED = Field("placed", pa.bool_(), lambda o: any(k in o for k in FIELD_QUAD_KEYS))
SCALARS = Field("scalars", pa.map_(pa.string(), pa.string()), _scalars)
STRINGS = Field("strings", pa.map_(pa.string(), pa.string()), lambda o: [(k, t) for k, v in o.items() if (t := _stripped(v))])
URI = Field("uri", pa.string(), lambda o: next((u for k, v in o.items() if "uri" in k.lower() and (u := _address(v))), None))

SHAPE = [("no", pa.int32()), ("parent", pa.int32()), ("key", pa.string()), ("is_item", pa.bool_()), ("pure", pa.bool_())]


def _objects(text: str | None, lang: str | None) -> Iterator[tuple]:
    """Objects of a JSON text, depth first: number, parent's, name, whether in a list, whether that holds objects only, itself."""
    root = _parsed(text)
    if lang and isinstance(root, dict) and isinstance(root.get("ocr_infos"), list):
        root = root | {"ocr_infos": [i for i in root["ocr_infos"] if isinstance(i, dict) and str(i.get("lang", "")).strip().lower() in ("", lang, "not_lang", "en")]}
    stack, number = [(root, -1, "", False, False)], 0
    while stack:
        value, parent, key, is_item, pure = stack.pop()
        if isinstance(value, dict):
            yield number, parent, key, is_item, pure, value
            stack.extend((v, number, k, False, False) for k, v in reversed(value.items()) if isinstance(v, (dict, list)))
            number += 1
        elif isinstance(value, list):
            whole = not is_item and all(isinstance(v, dict) for v in value)
            stack.extend((v, parent, key, True, whole) for v in reversed(value) if isinstance(v, (dict, list)))


def read_tree(payloads: DataFrame, keys, fields: Sequence[Field], column: str = "payload", lang: str | None = None) -> DataFrame:
    """One row per object of each JSON text, walked once: ``no`` (depth first), ``parent``, ``key``, ``is_item``, ``pure``
    and the fields asked for.

    ``pure`` says that the object stands in a list of objects only. A text that is null, no JSON or nested beyond what the
    parser takes gives no rows. With ``lang``, recognised lines of other languages are left out, see ``keep_language``.
    Texts are read where they lie: small tables are best ``dealt`` out before.
    """
    shape = pa.schema([*SHAPE, *[(f.name, f.kind) for f in fields]])
    kept = payloads.select(*keys, F.col(column).alias("_payload"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for at, text in enumerate(batch.column("_payload")):
                for *place, item in _objects(text.as_py(), lang):
                    owner.append(at)
                    rows.append((*place, *[f.read(item) for f in fields]))
                    if len(rows) >= PIECE:
                        yield _told(batch, owner, rows)
                        owner, rows = [], []
            if rows:
                yield _told(batch, owner, rows)

    def _told(batch: pa.RecordBatch, owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
        taken = pa.array(owner, pa.int32())
        own = [batch.column(k).take(taken) for k in keys]
        read = [pa.array(values, kind) for values, kind in zip(zip(*rows), shape.types)]
        return pa.RecordBatch.from_arrays([*own, *read], names=[*keys, *shape.names])

    kinds = dict(kept.dtypes)
    made = [f"`{n}` {from_arrow_type(t).simpleString()}" for n, t in zip(shape.names, shape.types)]
    return kept.mapInArrow(walk, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], *made]))


def json_nodes(payloads: DataFrame, keys, column: str = "payload") -> DataFrame:
    """One row per object of each JSON tree: its place, and its members that are plain values as ``scalars``."""
    return read_tree(payloads, keys, [SCALARS], column).drop("pure")


def general_boxes(payloads: DataFrame, keys, column: str = "payload", lang: str | None = None) -> DataFrame:
    """Text boxes of each answer in reading order of the answer: its main list first, then any other object.

    The main list is the first list of objects under a known name; without one, the first under a box name whose objects
    hold a text. A box is its text and points; of equal boxes the first counts. ``keys`` tell answers apart.
    """
    read = read_tree(payloads, keys, [TEXT, CONFIDENCE, POINTS, MAIN_LIST], column, lang)
    answer = Window.partitionBy(*keys)
    rank = F.array_position(F.array(*(F.lit(k) for k in QUAD_KEYS)), F.col("key"))
    named = F.min(F.when(F.col("main_list").isNotNull(), F.struct("no", F.col("main_list").alias("key")))).over(answer)
    boxed = F.min(F.when(F.col("pure") & (rank > 0) & F.col("text").isNotNull(), F.struct("parent", rank.alias("rank"), "key"))).over(answer)
    marked = read.withColumns({"_named": named, "_boxed": boxed}).where(F.col("text").isNotNull() & F.col("quad").isNotNull())
    home, name = F.coalesce("_named.no", "_boxed.parent"), F.coalesce("_named.key", "_boxed.key")
    first = F.coalesce(F.col("pure") & (F.col("parent") == home) & (F.col("key") == name), F.lit(False))
    found = marked.withColumn("_at", F.struct(F.when(first, 0).otherwise(1).alias("rank"), F.col("no").alias("no")))
    return found.groupBy(*keys, "text", "quad").agg(F.min_by("confidence", "_at").alias("confidence"), F.min("_at").alias("_at")).select(
        *keys, "text", "quad", "confidence", F.col("_at.rank").alias("list_rank"), F.col("_at.no").alias("node_no")
    )


def license_fields(payloads: DataFrame, keys, column: str = "payload") -> DataFrame:
    """Named fields of each answer from the first place that yields any: known containers, else any object."""
    read = cut_lineage(read_tree(payloads, keys, [TEXT, CONFIDENCE, POINTS, NAME, PLACED, STRINGS], column))
    points = F.when(F.col("placed"), F.col("quad")).alias("quad")
    # An object under a name is a field; without a text of its own it may hold one under ``Value``.
    deeper = read.where("key = 'Value' AND NOT is_item").select(*keys, F.col("parent").alias("no"), F.struct("text", "confidence", points).alias("_in"))
    objects = read.where("NOT is_item AND parent >= 0").join(deeper, [*keys, "no"], "left")
    own = F.when(F.col("text").isNotNull() | F.col("_in").isNull(), F.struct("text", "confidence", points)).otherwise(F.col("_in"))
    objects = objects.select(*keys, F.col("parent").alias("home"), F.col("key").alias("field"), own.alias("f"))
    none = F.lit(None)
    strings = read.select(*keys, F.col("no").alias("home"), F.explode("strings").alias("field", "_value"))
    strings = strings.select(*keys, "home", "field", F.struct(F.col("_value").alias("text"), none.cast("double").alias("confidence"), none.cast("array<array<double>>").alias("quad")).alias("f"))
    mapped = objects.unionByName(strings).where("f.text IS NOT NULL")
    # Containers of the root by rank; any object by its number after them.
    container = F.array_position(F.array(*(F.lit(k) for k in FIELD_CONTAINERS)), F.col("key")).cast("int")
    homes = read.where((F.col("parent") == 0) & ~F.col("is_item") & (container > 0)).select(*keys, F.col("no").alias("home"), container.alias("_rank"))
    in_map = mapped.join(homes, [*keys, "home"]).withColumn("_seq", F.lit(0))
    anywhere = mapped.withColumns({"_rank": F.col("home") + 100, "_seq": F.lit(0)})
    in_list = read.where((F.col("parent") == 0) & F.col("is_item") & (container > 0)).select(
        *keys, F.col("parent").alias("home"), F.col("name").alias("field"), F.struct("text", "confidence", points).alias("f"), container.alias("_rank"), F.col("no").alias("_seq")
    )
    found = cut_lineage(in_map.unionByName(anywhere).unionByName(in_list).where("field IS NOT NULL AND f.text IS NOT NULL"))
    best = found.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    kept = found.join(best, [*keys, "_rank"])
    return kept.groupBy(*keys, "field").agg(F.max_by("f", "_seq").alias("f")).select(*keys, "field", "f.*")


def object_key(uri: Column) -> Column:
    """Storage key of an address: its path without host, query and bucket prefix; null if nothing is left."""
    trimmed = F.trim(uri)
    path = F.when(trimmed.rlike("^https?://"), F.regexp_extract(trimmed, r"^https?://[^/?#]*([^?#]*)", 1)).otherwise(trimmed)
    plain = F.regexp_replace(F.ltrim(path, F.lit("/")), r"[?#].*$", "")
    key = F.ltrim(F.regexp_replace(plain, r"^tos-[^/]+-i-[^/]+/?", ""), F.lit("/"))
    return F.when(key != "", key)


def first_uri(resp: Column) -> Column:
    """First address in an upload answer: its ``Result``, then itself; single names before lists."""
    def of(root: Column) -> list[Column]:
        return [_first(F.transform(_members(root, URI_KEYS), lambda v: non_blank(text_of(v)))), _first(F.transform(_members(root, URI_LIST_KEYS), _first_listed))]

    return F.coalesce(*of(member(resp, "Result")), *of(resp))


def _first_listed(v: Column) -> Column:
    items = F.transform(
        F.when(is_array(v), F.try_variant_get(v, "$", "array<variant>")),
        lambda i: F.coalesce(non_blank(text_of(i)), _first(F.transform(_members(i, URI_KEYS), lambda v: non_blank(text_of(v))))),
    )
    return _first(items)


def find_uris(responses: DataFrame, keys, column: str = "resp") -> DataFrame:
    """Address in each upload answer: under the known names, else under the first name anywhere that holds ``uri``."""
    known = responses.select(*keys, column, first_uri(F.try_parse_json(F.col(column))).alias("_known"))
    nodes = read_tree(known.where("_known IS NULL"), keys, [URI], column).where("uri IS NOT NULL")
    first = nodes.groupBy(*keys).agg(F.min_by("uri", "no").alias("_uri"))
    return known.join(first, [*keys], "left").select(*keys, F.coalesce("_known", "_uri").alias("uri"))


def json_from_text(text: Column) -> Column:
    """The object in a model's answer: fenced, bare, or between the outermost braces."""
    raw = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    body = F.when(raw.startswith("```") & (fenced != ""), fenced).otherwise(raw)
    between = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    whole, part = F.try_parse_json(body), F.try_parse_json(F.when(between != "", between))
    return F.when(is_object(whole), whole).when(is_object(part), part)


def flatten_content(content: Column) -> Column:
    """Text of a message: a string, or the strings and ``text`` members of a list, one per line."""
    items = F.try_variant_get(content, "$", "array<variant>")
    parts = F.transform(items, lambda i: F.coalesce(text_of(i), text_of(member(i, "text"))))
    joined = F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n")
    return F.when(kind(content) == "STRING", text_of(content)).when(is_array(content), joined).otherwise(F.try_variant_get(content, "$", "string"))
