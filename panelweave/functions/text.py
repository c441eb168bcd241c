"""Text measures and small string functions as Columns."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_text(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, r"(?U)\s", ""))


def reachable(similarity: str, a: Column, b: Column, at_least: Column) -> Column:
    """Whether two normalised texts could be alike by ``at_least``, by their lengths alone."""
    la, lb = F.length(a), F.length(b)
    top = {"edit": F.lit(1.0) - F.abs(la - lb) / F.greatest(la, lb), "blocks": F.least(la, lb) * 2.0 / (la + lb)}[similarity]
    return F.when(la + lb == 0, True).otherwise((F.least(la, lb) > 0) & (top >= at_least))


#: Pairs of more cells than this (product of lengths) are measured by bit vectors, which pass many cells at a time.
LONG_PAIR = 1 << 17


def edit_distance(a: str, b: str) -> int:
    """Edits between two texts by Myers' bit vectors: one step per code point of the shorter, a bit per one of the longer."""
    if len(a) < len(b):
        a, b = b, a
    n, score = len(a), len(a)
    points = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), "<u4")
    held = {c: int.from_bytes(np.packbits(points == ord(c), bitorder="little").tobytes(), "little") for c in set(b)}
    full = up = (1 << n) - 1
    down = 0
    for c in b:
        same = held[c]
        flat = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = down | (full ^ (flat | up)), flat & up
        score += (rise.bit_length() == n) - (fall.bit_length() == n)
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full ^ (flat | rise)), flat & rise
    return score


def _long_distance(a: Column, b: Column, allowed: Column) -> Column:
    """Edits of the pairs that are there, -1 beyond ``allowed``."""
    @F.pandas_udf("int")
    def distances(left: pd.Series, right: pd.Series, most: pd.Series) -> pd.Series:
        found = [None if x is None or y is None else edit_distance(x, y) for x, y in zip(left, right)]
        return pd.Series([d if d is None or d <= m else -1 for d, m in zip(found, most)], dtype="Int32")

    # Said to be nondeterministic, so that no filter by the result is inferred below, where all would be measured a second time.
    return distances.asNondeterministic()(a, b, allowed)


def edit_similarity(a: Column, b: Column, at_least: Column | None = None, normalized: bool = False) -> Column:
    """1 - edit distance / longer length of the normalised texts; ``normalized`` says that they are.

    Pairs that cannot reach ``at_least`` give 0, without the full distance.  Long pairs of any but a narrow band go to
    Python as bit vectors; the others' texts do not.
    """
    na, nb = (a, b) if normalized else (normalize_text(a), normalize_text(b))
    longest = F.greatest(F.length(na), F.length(nb))
    least = F.lit(0.0) if at_least is None else at_least
    allowed = F.ceil(longest * (F.lit(1.0) - least)).cast("int")
    band = F.least(F.least(F.length(na), F.length(nb)), 2 * allowed + 1)
    long = (longest.cast("long") * band > LONG_PAIR) & (na != nb) & (F.abs(F.length(na) - F.length(nb)) <= allowed)
    far = _long_distance(F.when(long, na), F.when(long, nb), allowed)
    near = F.levenshtein(na, nb) if at_least is None else F.call_function("levenshtein", na, nb, allowed)
    distance = F.when(long, far).otherwise(near)
    # The one-element array lets the distance be named, so that it is worked out once.
    share = F.transform(F.array(distance), lambda d: F.when(d < 0, F.lit(0.0)).otherwise(F.lit(1.0) - d / longest))
    return (
        F.when(longest == 0, F.lit(1.0)).when(F.least(F.length(na), F.length(nb)) == 0, F.lit(0.0)).when(na == nb, F.lit(1.0))
        .when(F.abs(F.length(na) - F.length(nb)) > allowed, F.lit(0.0)).otherwise(F.element_at(share, 1))
    )


def strip(text: Column) -> Column:
    """Cut white space, line ends included, from both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def block_similarity(a: Column, b: Column, at_least: Column | None = None, normalized: bool = False) -> Column:
    """Matching-block ratio of the normalised texts; Arrow batches, for pairs already narrowed.

    The ratio is that of ``difflib.SequenceMatcher``. Long pairs that cannot reach ``at_least`` give 0 as soon as that shows.
    """
    least = F.lit(0.0) if at_least is None else at_least
    return _block_ratio(a, b, least) if normalized else _block_ratio(normalize_text(a), normalize_text(b), least)


#: ``difflib`` looks for no match at a character that makes up more than a hundredth of a second text this long.
LONG_TEXT = 200


def _longest_run(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int, cap: int) -> tuple[int, int, int]:
    """(size, i, j) of the longest run both ranges share, the first in ``a``, then in ``b``; none is longer than ``cap``."""
    size, at, i, find = 0, (alo, blo), alo, b.find
    while i + size < ahi and size < cap:
        j = find(a[i : i + size + 1], blo, bhi)
        while j >= 0:
            size += 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
            at = i, j
            j = find(a[i : i + size + 1], j + 1, bhi) if i + size < ahi and size < cap else -1
        i += 1
    return size, *at


def _rare_places(a: str, b: str) -> tuple[list[int], dict[str, list[int]]]:
    """Where ``a`` has characters that are in ``b`` and rare there, and where ``b`` has each of them."""
    codes = np.frombuffer((b + a).encode("utf-32-le", "surrogatepass"), "<u4")
    if codes.max() >= 1 << 16:
        codes = np.unique(codes, return_inverse=True)[1]
    n = len(b)
    held = np.bincount(codes[:n], minlength=int(codes.max()) + 1)
    rare = ((held > 0) & (held <= n // 100 + 1))[codes]
    places: dict[str, list[int]] = {}
    for j in np.flatnonzero(rare[:n]).tolist():
        places.setdefault(b[j], []).append(j)
    return np.flatnonzero(rare[n:]).tolist(), places


def _longest_rare_run(a: str, b: str, spots: list[int], places: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int, cap: int) -> tuple[int, int, int]:
    """As ``_longest_run``, of rare characters only."""
    size, at, last, runs = 0, (alo, blo), -2, {}
    for s in range(bisect_left(spots, alo), bisect_left(spots, ahi)):
        i = spots[s]
        held, before, now = places[a[i]], runs if i == last + 1 else {}, {}
        for j in held[bisect_left(held, blo) : bisect_left(held, bhi)]:
            k = now[j] = before.get(j - 1, 0) + 1
            if k > size:
                size, at = k, (i - k + 1, j - k + 1)
        if size == cap:
            break
        runs, last = now, i
    return size, *at


def _matching(a: str, b: str, at_least: float) -> int:
    """Characters in the matching blocks of ``difflib.SequenceMatcher``; 0 once a long pair shows that its ratio is below ``at_least``.

    The longest run splits both texts, and what lies on either side is split in turn. A run inside a range is no longer
    than the range's own, so looking for it ends at that size.
    """
    bound, total, whole, long = min(len(a), len(b)), 0, len(a) + len(b), len(b) >= LONG_TEXT
    rare = _rare_places(a, b) if long else None
    todo = [(0, len(a), 0, len(b), bound)]
    while todo:
        alo, ahi, blo, bhi, cap = todo.pop()
        size, i, j = run = _longest_rare_run(a, b, *rare, alo, ahi, blo, bhi, cap) if long else _longest_run(a, b, alo, ahi, blo, bhi, cap)
        if long:  # a run of rare characters goes on over others, and none at all over those both ranges begin with
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
        total += size
        bound += size - min(ahi - alo, bhi - blo)
        if run[0]:
            for part in ((alo, i, blo, j), (i + size, ahi, j + size, bhi)):
                if most := min(part[1] - part[0], part[3] - part[2]):
                    bound += most
                    todo.append((*part, run[0]))
        if long and 2.0 * bound / whole < at_least:
            return 0
    return total


def _ratio(a: str, b: str, at_least: float = 0.0) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    return 2.0 * _matching(a, b, at_least) / (len(a) + len(b))


def _block_ratio(a: Column, b: Column, at_least: Column) -> Column:
    @F.pandas_udf("double")
    def ratios(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x, y, m) for x, y, m in zip(left, right, least)], dtype="float64")

    # Nondeterministic as in ``_long_distance``.
    return ratios.asNondeterministic()(a, b, at_least)


SIMILARITIES = {"blocks": block_similarity, "edit": edit_similarity}
