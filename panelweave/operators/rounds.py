"""Greedy choices and components, reached in rounds of joins instead of one long loop.

Ids may be of any ordered type; where they are unique within a group only, a
struct of the group's keys and the id serves as id.
Every round is a Spark job over what is still undecided; its result goes to
the checkpoint folder, so that a lost executor costs no more than one round.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from panelweave.operators.spread import walked
from panelweave.session import cut_lineage


def _frozen(value):
    """An id as something a set can hold."""
    return tuple(map(_frozen, value.values())) if isinstance(value, dict) else value


def _split_by_component(edges: DataFrame, a: Column, b: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Edges with their ``component`` where it has at most ``most`` of them, and the edges of larger ones without."""
    tagged = cut_lineage(edges.withColumns({"_a": a, "_b": b}))
    named = components(tagged, "_a", "_b").withColumnRenamed("id", "_a")
    named = cut_lineage(tagged.join(named, "_a").drop("_a", "_b"))
    small = named.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).drop("_n")
    return named.join(small, "component"), named.join(small, "component", "left_anti").drop("component")


def _losers(rows: Iterable[tuple]) -> Iterator[tuple]:
    """Ids that lose in one component of conflicts (stronger, weaker): each conflict is looked at once."""
    conflicts = [(_frozen(hi), _frozen(lo), lo) for hi, lo in rows]
    rivals, below = Counter(lo for _, lo, _ in conflicts), defaultdict(list)
    for hi, lo, _ in conflicts:
        below[hi].append(lo)
    whole, lost = {lo: value for _, lo, value in conflicts}, set()
    decided = [hi for hi in below if hi not in rivals]
    while decided:
        one = decided.pop()
        for lo in below[one]:
            rivals[lo] -= 1
            if lo not in lost and (one not in lost or not rivals[lo]):
                if one not in lost:
                    lost.add(lo)
                decided.append(lo)
    yield from ((whole[lo],) for lo in lost)


def suppressed(conflicts: DataFrame, stronger: str = "hi", weaker: str = "lo", rounds: int = 3, most: int = 100_000) -> DataFrame:
    """Ids a greedy pass drops, given which earlier id would drop which later one.

    An id with no undecided stronger rival is kept and drops its weaker rivals; conflicts of dropped ids vanish.  This
    ends in the result of one ordered pass.  Few rounds leave only long chains; their components are then solved in one
    pass each, so the number of jobs does not follow a chain's length.  Components of more than ``most`` conflicts go on
    in rounds, which are spread over all tasks.
    """
    open_ = cut_lineage(conflicts.select(F.col(stronger).alias("hi"), F.col(weaker).alias("lo")).distinct())
    dropped = open_.select(F.col("lo").alias("id")).limit(0)
    done = 0
    while not open_.isEmpty():
        if done == rounds:
            small, open_ = _split_by_component(open_, F.col("hi"), F.col("lo"), most)
            schema = StructType([small.schema["component"], StructField("id", small.schema["lo"].dataType)])
            dropped = dropped.unionByName(cut_lineage(walked(small.select("component", "hi", "lo"), ["component"], ["hi", "lo"], schema, _losers).drop("component")))
            open_, done = cut_lineage(open_), done + 1
            continue
        threatened = open_.select(F.col("lo").alias("hi")).distinct()
        kept = open_.select("hi").distinct().join(threatened, "hi", "left_anti")
        lost = cut_lineage(open_.join(kept, "hi", "left_semi").select(F.col("lo").alias("id")).distinct())
        dropped = dropped.unionByName(lost)
        rest = open_.join(lost.withColumnRenamed("id", "lo"), "lo", "left_anti")
        open_ = cut_lineage(rest.join(lost.withColumnRenamed("id", "hi"), "hi", "left_anti").select("hi", "lo"))
        done += 1
    return dropped


def _pairs(rows: Iterable[tuple]) -> Iterator[tuple]:
    """One-to-one pairs of one component, its edges being read best first."""
    lefts, rights = set(), set()
    for _, left, right, weight in rows:
        a, b = _frozen(left), _frozen(right)
        if a not in lefts and b not in rights:
            lefts.add(a)
            rights.add(b)
            yield left, right, weight


def _matched_by_group(edges: DataFrame, group: Sequence[str], left: str, right: str, weight: str) -> DataFrame:
    """One pass over each group's edges."""
    schema = StructType([*[edges.schema[c] for c in group], *[edges.schema[c] for c in (left, right, weight)]])
    ordered = edges.select(*group, (-F.col(weight)).alias("_place"), left, right, weight)
    return walked(ordered, group, ["_place", left, right], schema, _pairs)


def matched(edges: DataFrame, left: str, right: str, weight: str, rounds: int = 3, most: int = 100_000, within: Sequence[str] = ()) -> DataFrame:
    """One-to-one pairs of a greedy pass by weight (high first), then left id, then right id.

    Every round takes the edges that are the best of both their ends.  As in ``suppressed``, what few rounds leave is
    solved in one pass over each component, and only components of more than ``most`` edges go on in rounds.

    ``within`` names columns of which no two values share an id.  Groups of up to ``most`` edges are then solved in one
    pass without any round, so that nothing of them is stored; ``edges`` are read twice and should be stored themselves.
    """
    if within:
        large = cut_lineage(edges.groupBy(*within).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*within))
        if large.isEmpty():
            return _matched_by_group(edges, within, left, right, weight)
        small = edges.join(large, [*within], "left_anti")
        ends = [F.struct(*within, c).alias(c) for c in (left, right)]
        told = matched(edges.join(large, [*within], "left_semi").select(*ends, weight), left, right, weight, rounds, most)
        told = told.select(f"{left}.*", F.col(f"{right}.{right}").alias(right), weight)
        return _matched_by_group(small, within, left, right, weight).unionByName(told)
    open_ = cut_lineage(edges.select(left, right, weight))
    chosen = open_.limit(0)
    best = F.min(F.struct((-F.col(weight)).alias("w"), F.col(left).alias("l"), F.col(right).alias("r")))
    done = 0
    while not open_.isEmpty():
        if done == rounds:
            a, b = (F.to_json(F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))) for side, c in (("l", left), ("r", right)))
            small, open_ = _split_by_component(open_, a, b, most)
            chosen = chosen.unionByName(cut_lineage(_matched_by_group(small, ["component"], left, right, weight).drop("component")))
            open_, done = cut_lineage(open_), done + 1
            continue
        by_left = open_.groupBy(left).agg(best.alias("top")).select(F.col("top.l").alias("l"), F.col("top.r").alias("r"), F.col("top.w").alias("w"))
        by_right = open_.groupBy(right).agg(best.alias("top")).select(F.col("top.l").alias("l"), F.col("top.r").alias("r"))
        mutual = cut_lineage(
            by_left.join(by_right, ["l", "r"]).select(F.col("l").alias(left), F.col("r").alias(right), (-F.col("w")).alias(weight))
        )
        chosen = chosen.unionByName(mutual)
        rest = open_.join(mutual.select(left), left, "left_anti").join(mutual.select(right), right, "left_anti")
        open_ = cut_lineage(rest.select(left, right, weight))
        done += 1
    return chosen


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge; a component is named by its smallest id.

    Alternates linking the larger and the smaller neighbours of each id to its
    smallest one, which needs few rounds even for long chains, until nothing
    but stars around smallest ids is left.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    pairs = cut_lineage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while not _stars(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.withColumnRenamed("m", "v"))
        pairs = cut_lineage(small.distinct())
    members = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


def _stars(pairs: DataFrame) -> bool:
    """Whether every larger id ``u`` has one pair only and is no other pair's ``v``: one shuffle of counts."""
    ends = pairs.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(pairs.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()
