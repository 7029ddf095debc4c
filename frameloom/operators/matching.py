"""Greedy one-to-one matching of events by distance of onset, then of peak, then by identifiers, without a row for each pair.

1. Onsets are dealt by their value, and all pairs of equal onset are settled where they meet.
2. What is left is dealt by windows of onset that overlap on both sides. In a window pairs are gone through in order; an
   event near the window's edge may have a partner beyond it, so it, and what it may take, is put in doubt. Matches of
   events without doubt are those of the whole; events in doubt go on to the next round, whose windows are wider.

A window holds its events and the places (onset, peak) that they share, and no pairs.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import _kept

#: Events that are settled in one window at the end.
AT_ONCE = 50_000
#: Windows, and groups of equal onsets, that events are dealt into at most.
MOST_WINDOWS = 4096
#: The first windows' width in tolerances; each round's are four times as wide.
WIDTH = 4
GT, CAND, MATCH = 0, 1, 2
FREE, DOUBT, TAKEN = 0, 1, 2


def _error_key(a, b) -> tuple:
    """The distance of two peaks as a sort key: numbers, then NaN, then missing ones."""
    if a is None or b is None:
        return (2, 0)
    error = abs(b - a)
    return (0, error) if error == error else (1, 0)


def _steps(gt_places: list[tuple], cand_places: list[tuple], tolerance: float) -> list[tuple]:
    """(onset error, {place of truth: places of found}) for each pair of errors in order."""
    order = sorted(range(len(cand_places)), key=lambda k: cand_places[k][0])
    onsets = [cand_places[k][0] for k in order]
    steps: dict[tuple, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
    for g, (onset, peak) in enumerate(gt_places):
        for k in range(bisect_left(onsets, onset - tolerance) if tolerance else bisect_left(onsets, onset), len(order)):
            error = abs(onsets[k] - onset)
            if error <= tolerance:
                steps[(error, *_error_key(peak, cand_places[order[k]][1]))][g].append(order[k])
            elif onsets[k] > onset:
                break
    return [(key[0], steps[key]) for key in sorted(steps)]


def _places(rows: pa.Table) -> tuple[list[tuple], list[int]]:
    """The distinct (onset, peak) of rows, and which each row has."""
    seen: dict[tuple, int] = {}
    at = [seen.setdefault(x, len(seen)) for x in zip(rows.column("onset").to_pylist(), rows.column("peak").to_pylist(), strict=True)]
    return list(seen), at


def _settled(rows: pa.Table, tolerance: float, edges: tuple[float, float] | None) -> tuple[pa.Table, pa.Table, list[int], list[bool], bytearray, list[int]]:
    """Events of each side by identifier; per event of truth the place of what it takes, or -1, and whether it is without
    doubt; per event found its state and what takes it. edges: the window's, None if nothing lies beyond it."""
    side = rows.column("side").to_numpy()
    gts, cands = (x.take(pc.sort_indices(x, sort_keys=[(key, "ascending")])) for x, key in ((rows.filter(pa.array(side == GT)), "gt_id"), (rows.filter(pa.array(side == CAND)), "cand_id")))
    (gt_places, gt_at), (cand_places, cand_at) = _places(gts), _places(cands)
    objects = gts.column("object").to_pylist()
    every: list[list] = [[[], 0, 0] for _ in cand_places]
    own: list[dict] = [defaultdict(lambda: [[], 0, 0]) for _ in cand_places]
    for k, (at, name) in enumerate(zip(cand_at, cands.column("object").to_pylist(), strict=True)):
        every[at][0].append(k)
        own[at][name][0].append(k)
    state, by, took, sure = bytearray(len(cand_at)), [-1] * len(cand_at), [-1] * len(gt_at), [True] * len(gt_at)
    # how far from an event all its partners lie in the window
    inner = lambda x: [min(float(v) - edges[0], edges[1] - float(v)) - tolerance / 1000 for v in x.column("onset").to_pylist()]
    reach, outer, rim = (inner(gts), inner(cands), 0) if edges else (None, [], 0)
    outermost = sorted((k for k, x in enumerate(outer) if x < tolerance), key=outer.__getitem__)
    waiting: list[list[int]] = [[] for _ in gt_places]
    for g, at in enumerate(gt_at):
        waiting[at].append(g)
    none = len(cand_at)
    for error, near in _steps(gt_places, cand_places, tolerance):
        while rim < len(outermost) and outer[outermost[rim]] < error:
            state[outermost[rim]] = state[outermost[rim]] or DOUBT
            rim += 1
        now = []
        for at in near:
            waiting[at] = [g for g in waiting[at] if took[g] < 0]
            now += waiting[at]
        for g in sorted(now):
            if reach and reach[g] < error:
                sure[g] = False
            name, maybe, free = objects[g], none, none
            for at in near[gt_at[g]]:
                for queue in (every[at],) if name is None else (own[at].get(name), own[at].get(None)):
                    if queue is None:
                        continue
                    items, a, b = queue
                    while a < len(items) and state[items[a]] == TAKEN:
                        a += 1
                    b = max(a, b)
                    while b < len(items) and state[items[b]] != FREE:
                        b += 1
                    queue[1], queue[2] = a, b
                    if a < len(items) and items[a] < maybe:
                        maybe = items[a]
                    if b < len(items) and items[b] < free:
                        free = items[b]
            if maybe == none:
                continue
            if maybe == free and sure[g]:
                took[g], by[free], state[free] = free, g, TAKEN
                continue
            sure[g] = False
            if free < none:
                state[free] = DOUBT
    return gts, cands, took, sure, state, by


def _result(gts: pa.Table, cands: pa.Table, took: list[int], gt_left: np.ndarray, cand_left: np.ndarray, schema: pa.Schema) -> pa.Table:
    """Matches of the window's own events, then its own events that are left."""
    mine = np.flatnonzero((np.array(took, np.int64) >= 0) & gts.column("core").to_numpy(zero_copy_only=False)) if took else np.zeros(0, np.int64)
    pairs = gts.take(pa.array(mine)).set_column(gts.schema.get_field_index("cand_id"), "cand_id", cands.column("cand_id").take(pa.array(np.array(took, np.int64)[mine])))
    pairs = pairs.set_column(pairs.schema.get_field_index("side"), "side", pa.array(np.full(len(mine), MATCH, np.int32)))
    return pa.concat_tables([x.select(schema.names).cast(schema) for x in (pairs, gts.filter(pa.array(gt_left)), cands.filter(pa.array(cand_left)))])


def _mask(values) -> np.ndarray:
    return np.array(values, bool)


def greedy_events(truth: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """(gt_id, cand_id) of truth (gt_id, gt_object, gt_onset, gt_peak) and found (cand_...), whose identifiers are unique, matched
    by onset, then peak, then identifiers. A missing or blank object is any object; onsets lie within the tolerance."""
    name = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    ids = {c: df.schema[c].dataType for c, df in (("gt_id", truth), ("cand_id", found))}
    part = lambda df, k, c: df.select(
        F.lit(k).alias("side"), *[(F.col(i) if i == f"{c}_id" else F.lit(None)).cast(t).alias(i) for i, t in ids.items()], name(f"{c}_object").alias("object"), F.col(f"{c}_onset").alias("onset"), F.col(f"{c}_peak").alias("peak")
    )
    now = part(truth, GT, "gt").unionByName(part(found, CAND, "cand")).where(F.abs(F.col("onset").cast("double")) < float("inf"))
    columns, kind = now.columns, now.schema

    def same(rows: pa.Table) -> pa.Table:
        gts, cands, took, _, state, _ = _settled(rows, min(0, tolerance), None)
        schema = rows.select(columns).schema
        return _result(gts, cands, took, _mask([t < 0 for t in took]), _mask([s != TAKEN for s in state]), schema)

    def window(width: float | None):
        def run(rows: pa.Table) -> pa.Table:
            first = rows.column("window")[0].as_py()
            gts, cands, took, sure, state, by = _settled(rows, tolerance, None if width is None else ((first - 1) * width, (first + 2) * width))
            of_gt, of_cand = (x.column("core").to_numpy(zero_copy_only=False) for x in (gts, cands))
            # an event found that an event of another window takes is matched there, or in a later round
            given = _mask([s == DOUBT or (s == TAKEN and not of_gt[b]) for s, b in zip(state, by, strict=True)])
            return _result(gts, cands, took, ~_mask(sure) & of_gt, given & of_cand, rows.select(columns).schema)

        return run

    onset = F.col("onset").cast("double") + 0.0  # no negative zero
    dealt = now.withColumns({"core": F.lit(True), "window": F.pmod(F.xxhash64(onset), F.lit(MOST_WINDOWS))})
    done = _kept(dealt.groupBy("window").applyInArrow(same, kind))
    matches, width = done.where(F.col("side") == MATCH).select("gt_id", "cand_id"), WIDTH * tolerance
    rest = done.where(F.col("side") != MATCH)
    while tolerance > 0:
        size = rest.agg(F.count("*").alias("n"), F.min(onset).alias("low"), F.max(onset).alias("high")).first()
        if not size.n:
            break
        wide = None if size.n <= AT_ONCE else float(max(width, (size.high - size.low) / MOST_WINDOWS))
        if wide is None:
            dealt = rest.withColumns({"core": F.lit(True), "window": F.lit(0).cast("long")})
        else:
            at = F.floor(onset / wide).cast("long")
            dealt = rest.withColumn("_at", at).withColumn("window", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).withColumn("core", F.col("_at") == F.col("window")).drop("_at")
        done = _kept(dealt.groupBy("window").applyInArrow(window(wide), kind))
        new = done.where(F.col("side") == MATCH).select("gt_id", "cand_id")
        matches = matches.unionByName(new)
        if wide is None:
            break
        rest = done.where(F.col("side") != MATCH).join(new.select("cand_id"), "cand_id", "left_anti").join(new.select("gt_id"), "gt_id", "left_anti").select(columns)
        width = 4 * wide
    return matches
