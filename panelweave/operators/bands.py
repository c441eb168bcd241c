"""From cuts to bands: merging cuts, intervals between bars, small and empty bands.

Cut tables hold keys, ``ord`` (list order), ``y``, ``strength``, ``kind``,
``span_y1``, ``span_y2`` and ``meta_e`` (edge note of the first cut merged in).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from panelweave.functions.geometry import band_content_score, clip
from panelweave.operators.spread import BUCKET, interval_sums, last_mark, neighbours, running_max, walked, with_halo
from panelweave.session import cut_lineage

# Which kind of cut names a group of cuts.
PRIORITY = {"black_bar": 3, "gutter": 2, "hard_line": 1}

CUT = ("y", "strength", "kind", "span_y1", "span_y2", "meta_e")

AFTER_ALL_CUTS = 1 << 40


def priority(kind: Column) -> Column:
    ranks = F.create_map(*(F.lit(v) for pair in PRIORITY.items() for v in pair))
    return F.coalesce(F.element_at(ranks, kind), F.lit(0))


def _exits(distance: int):
    """Per position of a bucket whether a gap lies before it, and the first anchor beyond the bucket if it were one itself."""

    def step(places: Iterable[tuple]) -> Iterator[tuple]:
        ys, own = zip(*places)
        n, out = len(ys), {}
        ahead, led = n, [None] * n
        for i in range(n - 1, -1, -1):
            while ahead and ys[ahead - 1] > ys[i] + distance:
                ahead -= 1
            # All between a place and the first one beyond its reach lie close together, if that one follows closely.
            near = ahead < n and ys[ahead] - ys[ahead - 1] <= distance
            led[i] = (led[ahead] if own[ahead] else ys[ahead]) if near else None
            if own[i]:
                out[i] = ys[i], i == 0 or ys[i] - ys[i - 1] > distance, led[i]
        yield from reversed(out.values())

    return step


def _walk_anchors(distance: int):
    def step(places: Iterable[tuple]) -> Iterator[tuple]:
        anchor = None
        for y, door in places:
            if door or (anchor is not None and y - anchor > distance):
                anchor = y
                yield (y,)

    return step


def _doors(places: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Positions by which chains enter a bucket from an earlier one, as ``_at``; None if no chain leaves its bucket."""
    exits = places.where("out IS NOT NULL")
    if exits.isEmpty():
        return None
    to = F.struct(*keys, F.col("out").alias("y"))
    entered = exits.select(to.alias("at"), F.lit(True).alias("_entered")).distinct()
    state = places.select(F.struct(*keys, "y").alias("at"), F.when(F.col("out").isNotNull(), to).alias("to"), F.col("door").alias("anchor"))
    state = cut_lineage(state.join(entered, "at", "left").where("_entered OR (anchor AND to IS NOT NULL)").drop("_entered"))
    while not (led := state.where("anchor AND to IS NOT NULL").select(F.col("to").alias("at"), F.lit(True).alias("_led"))).isEmpty():
        ahead = state.select(F.col("at").alias("to"), F.col("to").alias("_next"))
        stepped = state.join(led.distinct(), "at", "left").join(ahead, "to", "left")
        state = cut_lineage(stepped.select("at", F.col("_next").alias("to"), (F.col("anchor") | F.col("_led").isNotNull()).alias("anchor")))
    return state.where("anchor").select(F.col("at").alias("_at"), F.lit(True).alias("_door"))


def _anchors(cuts: DataFrame, keys: Sequence[str], distance: int, size: int = 4096) -> DataFrame:
    """Positions at which a group of cuts begins: the first after a gap, and from an anchor the first one beyond ``distance``.

    A bucket tells for each of its positions where the chain from there leaves it.  Marks then go from bucket to bucket
    along those exits while the steps double, so a stretch over b buckets takes log2(b) rounds of its few exits, and each
    bucket is walked by itself from the doors found.
    """
    near = with_halo(cuts.select(*keys, "y").distinct(), keys, "y", distance, 2 * distance, size)
    group = [*keys, BUCKET]
    kinds = StructType([*near.select(*group, "y").schema.fields, StructField("door", BooleanType()), StructField("out", near.schema["y"].dataType)])
    places = cut_lineage(walked(near.select(*group, "y", "_own"), group, ["y"], kinds, _exits(distance)))
    doors = _doors(places, keys)
    opened = places.select(*group, "y", "door")
    if doors is not None:
        far = opened.withColumn("_at", F.struct(*keys, "y")).join(doors, "_at", "left")
        opened = far.select(*group, "y", (F.col("door") | F.col("_door").isNotNull()).alias("door"))
    return walked(opened, group, ["y"], near.select(*group, "y").schema, _walk_anchors(distance)).drop(BUCKET)


def merge_cuts(cuts: DataFrame, keys: Sequence[str], distance: int = 25) -> DataFrame:
    """Merge cuts within ``distance`` of the first cut of their group; chains do not extend a group.

    The kind is that of the first cut of highest priority, the edge note that of the first cut.
    """
    cuts = cut_lineage(cuts.select(*keys, "ord", *CUT))
    anchors = _anchors(cuts, keys, distance)
    placed = last_mark(cuts, anchors, keys, F.col("y"), F.col("y"), [F.col("y")], "_anchor")
    place = F.struct("y", "ord")
    groups = placed.groupBy(*keys, F.col("_anchor.y").alias("_y")).agg(
        F.max("strength").alias("strength"), F.min_by("kind", F.struct((-priority(F.col("kind"))).alias("rank"), "y", "ord")).alias("kind"),
        F.min("span_y1").alias("span_y1"), F.max("span_y2").alias("span_y2"), F.min_by("meta_e", place).alias("meta_e"), F.count(F.lit(1)).cast("int").alias("merged"),
    )
    return groups.withColumnRenamed("_y", "y").withColumn("ord", F.col("y").cast("long"))


def bar_spans(cuts: DataFrame, keys: Sequence[str], min_height: int = 24, distance: int = 8) -> DataFrame:
    """Spans of bars, merged where the next one starts within ``distance`` of all before it."""
    bars = cuts.where((F.col("kind") == "black_bar") & (F.col("span_y2") - F.col("span_y1") >= min_height))
    bars = bars.select(*keys, "ord", F.col("span_y1").alias("y1"), F.col("span_y2").alias("y2"), "strength", F.col("meta_e").alias("edge"))
    order = [F.col("y1"), F.col("ord")]
    reach = running_max(bars, keys, order, F.col("y1"), F.col("y2"), "_reach", include_current=False)
    first = F.when(F.coalesce(F.col("y1") > F.col("_reach") + distance, F.lit(True)), F.col("y1"))
    named = running_max(reach, keys, order, F.col("y1"), first, "_span")
    return named.groupBy(*keys, "_span").agg(
        F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.max("strength").alias("strength"), F.max("edge").alias("edge")
    ).drop("_span")


def split_intervals(intervals: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cut disjoint intervals (``iv_y1, iv_y2``) at the distinct cuts strictly inside them."""
    valid = intervals.where("iv_y2 > iv_y1").select(*keys, "iv_y1", "iv_y2")
    placed = last_mark(cuts.select(*keys, "y").distinct(), valid, keys, F.col("y"), F.col("iv_y1"),
                       [F.col("iv_y1"), F.col("iv_y2")], name="iv", inclusive=False)
    inner = placed.where(F.col("y") < F.col("iv.iv_y2")).select(*keys, "iv.iv_y1", "iv.iv_y2", "y")
    starts = valid.withColumn("y", F.col("iv_y1")).unionByName(inner)
    back = -F.col("y")
    ahead = running_max(starts, [*keys, "iv_y1"], [back], back, back, "_next", include_current=False)
    return ahead.select(*keys, "iv_y1", "iv_y2", F.col("y").alias("y1"), F.coalesce(-F.col("_next"), F.col("iv_y2")).alias("y2"))


def _walk_small(min_height: int):
    """Walk a stretch: a band low enough waits for the next, or widens the last one done."""

    def step(bands: Iterable[tuple]) -> Iterator[tuple]:
        last = waiting = None
        for y1, y2, above, below in bands:
            y1 = y1 if waiting is None else waiting
            first, final, waiting = above is None, below is None, None
            if y2 - y1 >= min_height or (final and (first or last is None)):
                if last:
                    yield last
                last = y1, y2
            elif first or (not final and (last is None or below >= last[1] - last[0])):
                waiting = y1
            else:
                last = last[0], y2
        if last:
            yield last

    return step


def merge_small(raw: DataFrame, keys: Sequence[str], min_height: int = 180) -> DataFrame:
    """Merge bands under ``min_height`` into a neighbour, left to right, per interval.

    First goes right, last goes left, others to the taller side (right on ties).
    Two tall bands side by side never exchange rows, so that the walk is split there.
    """
    keys = [*keys, "iv_y1", "iv_y2"]
    linked = neighbours(raw.select(*keys, "y1", "y2"), keys, F.col("y1"), ["y1", "y2"])
    height = F.col("y2") - F.col("y1")
    linked = cut_lineage(linked.select(*keys, "y1", "y2", *[(F.col(n)["y2"] - F.col(n)["y1"]).alias(f"{n}_h") for n in ("prev", "next")]))
    starts = F.col("prev_h").isNull() | ((F.col("prev_h") >= min_height) & (height >= min_height))
    parts = running_max(linked, keys, [F.col("y1")], F.col("y1"), F.when(starts, F.col("y1")), "_part")
    group = [*keys, "_part"]
    schema = parts.select(*group, "y1", "y2").schema
    return walked(parts.select(*group, "y1", "y2", "prev_h", "next_h"), group, ["y1"], schema, _walk_small(min_height)).drop("_part")


def score_bands(bands: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score and reason of a band from the nearest cut above and below it.

    Lacking both, the cuts inside it; lacking any, a low score.
    """
    payload = [(-F.col("ord")).alias("tie"), F.col("strength"), F.col("kind")]
    seen = last_mark(bands, cuts, keys, F.col("y1"), F.col("y"), payload, name="above")
    seen = last_mark(seen, cuts, keys, F.col("y2"), F.col("y"), payload, name="below", backward=False)
    lone = seen.where("above IS NULL AND below IS NULL").select(*keys, "y1", "y2")
    inside = lone.join(cuts, [*keys]).where("y BETWEEN y1 AND y2").groupBy(*keys, "y1", "y2").agg(
        F.avg("strength").alias("in_mean"), F.max(F.struct(priority(F.col("kind")).alias("p"), -F.col("ord"), F.col("kind"))).alias("in_top")
    )
    any_cut = cuts.groupBy(*keys).agg(F.lit(True).alias("has_cuts"))
    joined = seen.join(inside, [*keys, "y1", "y2"], "left").join(any_cut, [*keys], "left")
    above, below = F.col("above"), F.col("below")
    mean = F.when(above.isNotNull() & below.isNotNull(), (above["strength"] + below["strength"]) / 2.0)
    mean = mean.otherwise(F.coalesce(above["strength"], below["strength"], F.col("in_mean")))
    below_wins = above.isNull() | (priority(below["kind"]) > priority(above["kind"]))
    reason = F.when(below.isNotNull() & below_wins, below["kind"]).otherwise(F.coalesce(above["kind"], F.col("in_top.kind")))
    known = F.coalesce("has_cuts", F.lit(False))
    return joined.withColumns({
        "score": clip(F.coalesce(mean, F.when(known, F.lit(0.3)).otherwise(F.lit(0.2))), 0.0, 1.0),
        "reason": F.coalesce(reason, F.when(known, F.lit("structure")).otherwise(F.lit("fallback_chunk"))),
    }).drop("above", "below", "in_mean", "in_top", "has_cuts")


def fallback_chunks(images: DataFrame, keys: Sequence[str], chunk: int = 2600) -> DataFrame:
    """Fixed chunks for images (``height``) without any cut."""
    starts = images.where("height > 0").withColumn("y1", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(chunk))))
    return starts.select(
        *keys, "y1", F.least(F.col("y1") + chunk, F.col("height")).alias("y2"), F.lit(0.2).alias("score"), F.lit("fallback_chunk").alias("reason")
    )


def build_bands(images: DataFrame, cuts: DataFrame, keys: Sequence[str], min_height: int = 180, chunk: int = 2600) -> DataFrame:
    """Bars become bands of their own; what lies between them is cut, merged and scored.

    Cuts are few next to the rows they come from; each step reads them more
    than once, so that the steps are written to the checkpoint folder.
    """
    images = cut_lineage(images.select(*keys, "height"))
    cuts = cut_lineage(cuts.select(*keys, "ord", *("y", "strength", "kind", "span_y1", "span_y2", "meta_e")))
    spans = cut_lineage(bar_spans(cuts, keys))
    edges = spans.select(
        *keys, F.explode(F.array("y1", "y2")).alias("y"), F.greatest(F.lit(0.8), F.col("strength")).alias("strength"),
        F.lit("black_bar").alias("kind"), F.lit(AFTER_ALL_CUTS).alias("ord"),
    )
    all_cuts = cuts.select(*keys, "y", "strength", "kind", "ord").unionByName(edges)
    bars = spans.join(images, [*keys]).withColumns(
        {"y1": clip(F.col("y1"), 0, F.col("height")), "y2": clip(F.col("y2"), 0, F.col("height"))}
    )
    before = running_max(bars, keys, [F.col("y1"), F.col("y2")], F.col("y1"), F.col("y2"), "_before", include_current=False)
    with_cuts = images.join(cuts.select(*keys).distinct(), [*keys], "left_semi")
    tails = with_cuts.join(bars.groupBy(*keys).agg(F.max("y2").alias("_end")), [*keys], "left")
    intervals = before.select(*keys, F.coalesce("_before", F.lit(0)).alias("iv_y1"), F.col("y1").alias("iv_y2")).unionByName(
        tails.select(*keys, F.coalesce("_end", F.lit(0)).alias("iv_y1"), F.col("height").alias("iv_y2"))
    )
    raw = cut_lineage(split_intervals(cut_lineage(intervals), all_cuts, keys))
    between = cut_lineage(merge_small(raw, keys, min_height).drop("iv_y1", "iv_y2"))
    between = score_bands(between, all_cuts, keys).select(*keys, "y1", "y2", "score", "reason")
    score = clip(0.6 + 0.4 * F.col("strength"), 0.0, 1.0)
    score = F.when(F.col("edge") >= 0.02, F.least(score, F.lit(0.45))).otherwise(score)
    own = bars.where("y2 > y1").select(*keys, "y1", "y2", score.alias("score"), F.lit("black_bar_band").alias("reason"))
    bare = fallback_chunks(images.join(cuts.select(*keys).distinct(), [*keys], "left_anti"), keys, chunk)
    return between.unionByName(own).unionByName(bare)


def band_feature_means(bands: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums and means of white and edge shares over each band's rows."""
    named = {"white_ratio": "white_sum", "edge_density": "edge_sum", "n_rows": "row_count"}
    found = interval_sums(bands.select(*keys, "y1", "y2").distinct(), rows, keys, ["white_ratio", "edge_density"]).withColumnsRenamed(named)
    sums = found.select(F.struct(*keys, "y1", "y2").alias("_band"), *named.values())
    return bands.withColumn("_band", F.struct(*keys, "y1", "y2")).join(sums, "_band").drop("_band").withColumns({
        "white_mean": F.coalesce(F.try_divide(F.col("white_sum"), F.col("row_count")), F.lit(0.0)),
        "edge_mean": F.coalesce(F.try_divide(F.col("edge_sum"), F.col("row_count")), F.lit(0.0)),
    })


def _content(white_sum: float, edge_sum: float, rows: int) -> float:
    """The score of ``band_content_score`` from sums over a band's rows; 0 without rows."""
    if not rows:
        return 0.0
    blank, edges = min(max(1.0 - white_sum / rows, 0.0), 1.0), min(max(edge_sum / rows, 0.0), 1.0)
    return min(max(0.6 * blank + 0.4 * min(edges / 0.02, 1.0), 0.0), 1.0)


def _walk_empty(min_height: int, small: int, small_at_end: int, threshold: float):
    """Walk a stretch: a low band of little content joins the neighbour with more of it, and the walk steps back one.

    What lies behind is a stack and what lies ahead is read on, so a step costs the same however long the stretch is.
    """

    def pull(band: list) -> float:
        return band[-1] + 0.15 * min(max(band[1] - band[0], 1) / max(min_height, 1), 1.0)

    def joined(into: list, band: list) -> list:
        y1, y2, score, reason, *sums = min(into[0], band[0]), max(into[1], band[1]), max(into[2], band[2]), into[3], *[into[k] + band[k] for k in (4, 5, 6)]
        return [y1, y2, score, reason, *sums, into[7] or band[7], into[8] or band[8], _content(*sums)]

    def step(bands: Iterable[tuple]) -> Iterator[tuple]:
        ahead = ([*b, _content(*b[4:7])] for b in bands)
        behind, after = [], next(ahead, None)
        while after is not None:
            band, after = after, next(ahead, None)
            while band is not None:
                outer = band[7] or band[8]
                stays = band[1] - band[0] >= (small_at_end if outer else small) or band[-1] >= threshold * (1.25 if outer else 1.0)
                if stays or not (behind or after):
                    behind.append(band)
                    band = None
                elif after is None or (behind and pull(behind[-1]) >= pull(after)):
                    band = joined(behind.pop(), band)
                else:
                    after = joined(after, band)
                    band = behind.pop() if behind else None
        yield from (band[:4] for band in behind)

    return step


def refine_bands(bands: DataFrame, rows: DataFrame, keys: Sequence[str], min_height: int = 180, small_ratio: float = 0.85,
                 end_ratio: float = 1.4, threshold: float = 0.17) -> DataFrame:
    """Join low bands without content to the neighbour with more of it; never to a bar.

    Nothing crosses a bar or the border of two tall bands, so that each stretch
    between those is one small task, and stretches without a candidate skip Python.
    """
    small = max(1, int(min_height * small_ratio))
    small_at_end = max(small, int(min_height * end_ratio))
    means = cut_lineage(band_feature_means(bands.select(*keys, "y1", "y2", "score", "reason"), rows, keys))
    ends = means.groupBy(*keys).agg(F.min("y1").alias("_lo"), F.max("y2").alias("_hi"))
    is_bar = F.col("reason") == "black_bar_band"
    tall = is_bar | (F.col("y2") - F.col("y1") >= small_at_end)
    marked = means.join(ends, [*keys]).withColumns({"is_first": F.col("y1") == F.col("_lo"), "is_last": F.col("y2") == F.col("_hi"), "_tall": tall})
    marked = marked.where(~is_bar)
    before = means.select(F.struct(*keys, F.col("y2").alias("y1")).alias("_end"), tall.alias("_left_tall"), is_bar.alias("_left_bar")).where("_end.y1 > 0")
    linked = marked.withColumn("_end", F.struct(*keys, "y1")).join(before, "_end", "left").drop("_end")
    starts = F.coalesce(F.col("_left_bar") | (F.col("_tall") & F.col("_left_tall")), F.lit(True))
    parts = running_max(linked, keys, [F.col("y1")], F.col("y1"), F.when(starts, F.col("y1")), "_part")
    low = band_content_score(F.col("white_mean"), F.col("edge_mean")) < threshold * 1.25
    marked = cut_lineage(parts.withColumn("_low", ~F.col("_tall") & low))
    group, kept = [*keys, "_part"], ["y1", "y2", "score", "reason"]
    busy = marked.groupBy(F.struct(*group).alias("_stretch")).agg((F.bool_or("_low") & (F.count(F.lit(1)) > 1)).alias("_busy"))
    told = marked.withColumn("_stretch", F.struct(*group)).join(busy, "_stretch").drop("_stretch")
    todo = told.where("_busy").select(*group, *kept, "white_sum", "edge_sum", "row_count", "is_first", "is_last")
    done = walked(todo, group, ["y1"], todo.select(*group, *kept).schema, _walk_empty(min_height, small, small_at_end, threshold))
    bars = means.where(is_bar).select(*keys, *kept)
    return done.select(*keys, *kept).unionByName(told.where("NOT _busy").select(*keys, *kept)).unionByName(bars)
