"""Join shapes that Spark has no operator for: ranges, distances, as-of, nearest and greedy one-to-one matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import _kept
from .matching import greedy_events

#: Pairs that greedy matching takes one after another in one task at most.
AT_ONCE = 50_000
#: Widths of squares that the search for the nearest goes through at most.
MOST_WIDTHS = 10
#: Rows of a task where owners of items are paired.
ITEM_ROWS = 100_000
#: Shares that the rows of a bin are dealt into where a bin may hold very many of all rows.
SHARES = 8
#: Rows of one place that a list of truth and one of found hold, about. Spark keeps all pairs of two lists that meet
#: before it passes them on. A page of a parquet file holds many turns of so short a list, and compresses them.
OUTER, PIECE = 200, 200


def binned_join(left: DataFrame, right: DataFrame, on: Sequence[str], near: Sequence[tuple[str, str, float]], how: str = "inner", circle: float | None = None, shares: int = 1) -> DataFrame:
    """Rows of left and right that agree in `on` and lie within a radius in each of `near` (left column, right column, radius).

    Both sides are put into bins one radius wide and right is repeated into the neighbouring bins, so the join has equal
    keys and each pair meets once. Column names of the two sides differ but for `on`; rows with a null in a key never meet.
    circle: the largest distance over all of `near` together. Few rows may give many pairs, so the bins are dealt over all
    tasks however small the sides are, and no side, repeated as it is, is sent to every task.
    shares: parts that left's rows of a bin are dealt into; right is repeated for each.
    """
    a, b = left, right
    keys = list(on)
    for k, (x, y, radius) in enumerate(near):
        width = radius if radius > 0 else 1.0
        a = a.withColumn(f"_bin{k}", F.floor(F.col(x) / width))
        at = F.floor(F.col(y) / width)
        b = b.withColumn(f"_bin{k}", F.explode(F.array(at - 1, at, at + 1)))
        keys.append(f"_bin{k}")
    if shares > 1:
        a, b = a.withColumn("_share", F.pmod(F.xxhash64(*left.columns), F.lit(shares)).cast("int")), b.withColumn("_share", F.explode(F.array(*map(F.lit, range(shares)))))
        keys.append("_share")
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = a.repartition(parts, *keys), b.repartition(parts, *keys).hint("merge")
    apart = lambda x, y: F.pow(F.col(x).cast("double") - F.col(y).cast("double"), 2)
    close = [F.abs(F.col(x) - F.col(y)) <= radius for x, y, radius in near]
    if circle is not None:
        close.append(F.sqrt(sum((apart(x, y) for x, y, _ in near), F.lit(0.0))) <= circle)
    if how == "inner":
        out = a.join(b, keys)
        for c in close:
            out = out.where(c)
        return out.drop(*[f"_bin{k}" for k in range(len(near))], "_share")
    if how not in ("left_semi", "left_anti"):
        raise ValueError("how is inner, left_semi or left_anti")
    condition = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.abs(F.col(f"a.{x}") - F.col(f"b.{y}")) <= radius for x, y, radius in near]
    if circle is not None:
        condition.append(F.sqrt(sum((apart(f"a.{x}", f"b.{y}") for x, y, _ in near), F.lit(0.0))) <= circle)
    out = a.alias("a").join(b.alias("b"), condition, how)
    return out.drop(*[f"_bin{k}" for k in range(len(near))], "_share")


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the latest row of right at or before it, within `by`; null if there is none.

    The sides are put together and the last value seen is carried on, so nothing is joined and no pairs are made. Of
    rows of right at the same place the one with the largest values counts.
    """
    carried = F.struct(*[F.col(v) for v in values])
    rest = [c for c in left.columns if c not in by and c != at]
    a = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*rest).alias("_row") if rest else F.lit(None).alias("_row"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("_value"))
    b = right.select(*by, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), carried.alias("_value"))
    before = Window.partitionBy(*by).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_value", ignorenulls=True).over(before)).where("_side = 1")
    return both.select(*by, at, *[F.col(f"_row.{c}").alias(c) for c in rest], *[F.col(f"_last.{v}").alias(v) for v in values])


def asof_by_range(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, values: Sequence[str], width: float) -> DataFrame:
    """As asof_backward, but in ranges of `at` of this width, so that the rows of one key are worked on by many tasks.

    1. In each range of a key the last value seen is carried on, as in asof_backward.
    2. The last value of each range is carried on to the ranges behind it, over one row for each range of a key.
    3. Rows that have nothing before them in their own range take what their range was given.
    """
    carried, part = F.struct(*[F.col(v) for v in values]), F.floor(F.col(at) / width).cast("long")
    keys = [*by, "_part"]
    rest = [c for c in left.columns if c not in by and c != at]
    held = right.select(carried.alias("x")).schema["x"].dataType
    a = left.select(*by, at, part.alias("_part"), F.lit(1).alias("_side"), F.struct(*rest).alias("_row") if rest else F.lit(None).alias("_row"), F.lit(None).cast(held).alias("_value"))
    b = right.select(*by, at, part.alias("_part"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), carried.alias("_value"))
    both = a.unionByName(b)
    before = Window.partitionBy(*keys).orderBy(at, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_last", F.last("_value", ignorenulls=True).over(before)).where("_side = 1")
    ends = both.groupBy(*keys).agg(F.max(F.when(F.col("_side") == 0, F.struct(at, "_value"))).alias("_end"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    given = ends.select(*keys, F.last("_end", ignorenulls=True).over(ahead).alias("_given")).where("_given is not null")
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in keys]
    out = own.alias("o").join(given.alias("g"), same, "left").select(*[F.col(f"o.{c}").alias(c) for c in (*by, at)], "_row", F.coalesce("_last", "_given._value").alias("_last"))
    return out.select(*by, at, *[F.col(f"_row.{c}").alias(c) for c in rest], *[F.col(f"_last.{v}").alias(v) for v in values])


def event_pairs(truth: DataFrame, found: DataFrame, left: str, right: str, near: Sequence[tuple[str, str, float]]) -> DataFrame:
    """Pairs of events of the same object that lie within the distances of `near` (see binned_join); columns of the sides differ.

    left, right: the sides' object columns. A missing or empty object is any object: rows are joined by object and place
    where both have one, else by place alone, so no condition has an alternative in it and each pair meets once.

    Rows alike in place (and object) are one list, and lists meet, so a pair is a row only in the task that gives it out.
    There the rows of one event of truth follow each other and those of found come in the same order for each, so that
    columnar files, which write runs and repetitions once, hold a pair in a fraction of a byte.
    """
    named = lambda df, c: df.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    blank = lambda df, c: df.where(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "")
    columns = [*truth.columns, *found.columns]
    at = [list(dict.fromkeys(c)) for c in zip(*((x, y) for x, y, _ in near), strict=True)]
    object_of = lambda df, c: named(df, c).withColumn("_object", F.trim(F.col(c).cast("string")))
    own = binned_join(_lists(object_of(truth, left), ["_object", *at[0]], OUTER), _lists(object_of(found, right), ["_object", *at[1]], PIECE), ["_object"], near)
    back = [(y, x, radius) for x, y, radius in near]  # the side that is dealt has most rows, the other is repeated
    wild = [binned_join(_lists(found, at[1], PIECE, SHARES), _lists(blank(truth, left), at[0], OUTER), [], back, shares=SHARES)]
    wild.append(binned_join(_lists(named(truth, left), at[0], OUTER, SHARES), _lists(blank(found, right), at[1], PIECE), [], near, shares=SHARES))
    lists = [[c for c in df.columns if c not in x] for df, x in zip((truth, found), at, strict=True)]
    return reduce(DataFrame.unionByName, (_unlisted(x, *lists).select(columns) for x in (own, *wild)))


def _lists(rows: DataFrame, keys: Sequence[str], size: int, least: int = 1) -> DataFrame:
    """The keys and, in place of each other column, a list of its values in rows that agree in the keys; rows without a key are left out.

    A list holds `size` rows, about, or fewer, so that rows which agree are `least` lists. They are sorted by their
    columns from last to first, as identifiers, which repeat least, come first.
    """
    rest = [c for c in reversed(rows.columns) if c not in keys]
    many = rows.groupBy(*keys).agg(F.count("*").alias("_many"))
    piece = F.pmod(F.xxhash64(*rest), F.greatest(F.lit(least), F.ceil(F.col("_many") / size))).alias("_piece")
    lists = rows.join(many, list(keys)).groupBy(*keys, piece).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("_rows"))
    return lists.select(*keys, *[F.col(f"_rows.{c}").alias(c) for c in rest])


def _unlisted(pairs: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """pairs of lists as pairs of their rows: first, second are the list columns of each side.

    coalesce() leaves the partitions as they are, but parts the join from what is made of its rows: joined to it in one
    step, Spark would keep the pairs of a list with all the lists that it meets before it passes one on.
    """
    pairs = pairs.coalesce(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rest = [c for c in pairs.columns if c not in (*first, *second)]
    each = pairs.select("*", F.posexplode(first[0]).alias("_i", "_a")).select("*", F.posexplode(second[0]).alias("_j", "_b"))
    one = lambda names, k, value: [F.col(value).alias(names[0]), *[F.get(c, F.col(k)).alias(c) for c in names[1:]]]
    return each.select(*rest, *one(first, "_i", "_a"), *one(second, "_j", "_b"))


def match_events(truth: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """One-to-one matches of truth (gt_id, gt_object, gt_onset, gt_peak, gt_duration) and found (cand_...), by onset, then peak, then ids.

    Onsets lie within the tolerance. Returns ids and onset_error, peak_error, duration_error (found less true). Where
    identifiers are unique, no row is made for a pair that is not taken.
    """
    errors = [(F.col(f"cand_{c}") - F.col(f"gt_{c}")).alias(f"{c}_error") for c in ("onset", "peak", "duration")]
    if all(df.groupBy(key).count().where("count > 1").isEmpty() for df, key in ((truth, "gt_id"), (found, "cand_id"))):
        taken = greedy_events(truth, found, tolerance)
        known = lambda df, key: taken[key].eqNullSafe(df[key])
        return taken.join(truth, known(truth, "gt_id")).drop(truth["gt_id"]).join(found, known(found, "cand_id")).drop(found["cand_id"]).select("gt_id", "cand_id", *errors)
    pairs = event_pairs(truth, found, "gt_object", "cand_object", [("gt_onset", "cand_onset", tolerance)]).select("gt_id", "cand_id", *errors)
    pairs = pairs.withColumns({"_o": F.abs("onset_error"), "_p": F.abs("peak_error")})
    return greedy_match(pairs, "gt_id", "cand_id", ["_o", "_p", "gt_id", "cand_id"]).drop("_o", "_p")


def nearest(points: DataFrame, targets: DataFrame, xy: tuple[str, str], target_xy: tuple[str, str], target_id: str, radius: float) -> DataFrame:
    """points with the nearest target within a radius and its distance; ties go to the smallest target. Points without one are left out.

    Places that several points or targets share are compared once. The search begins in squares so small that targets are
    few in each, and places that have no target within a square's width go on to squares four times as wide, up to the
    radius; so what is compared grows with the places.
    """
    place = lambda df, names, own: df.withColumns({o: F.col(c).cast("double") for o, c in zip(own, names, strict=True)})
    spots = _kept(place(targets, target_xy, ("_tx", "_ty")).where("_tx is not null and _ty is not null").groupBy("_tx", "_ty").agg(F.min(target_id).alias("_id")))
    rows = place(points, xy, ("_px", "_py"))
    left = _kept(rows.select("_px", "_py").where("_px is not null and _py is not null").distinct())
    size = spots.agg(F.count("*").alias("n"), (F.max("_tx") - F.min("_tx")).alias("x"), (F.max("_ty") - F.min("_ty")).alias("y")).first()
    widths = [radius]
    while radius > 0 and size.n and len(widths) < MOST_WIDTHS and (size.x / widths[0] + 1) * (size.y / widths[0] + 1) < size.n:
        widths.insert(0, widths[0] / 4)
    best = []
    for k, width in enumerate(widths):
        pairs = binned_join(left, spots, [], [("_px", "_tx", width), ("_py", "_ty", width)])
        pairs = pairs.withColumn("distance", F.hypot(F.col("_px") - F.col("_tx"), F.col("_py") - F.col("_ty"))).where(F.col("distance") <= width)
        best.append(_kept(pairs.groupBy("_px", "_py").agg(F.min(F.struct("distance", "_id")).alias("_best"))))
        if k + 1 < len(widths):
            left = _kept(left.join(best[-1], ["_px", "_py"], "left_anti"))
    found = rows.distinct().join(reduce(DataFrame.unionByName, best), ["_px", "_py"])
    return found.select(*points.columns, F.col("_best._id").alias(f"nearest_{target_id}"), F.col("_best.distance").alias("distance"))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that give each ITEM_ROWS rows at most, as many as a shuffle makes at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ITEM_ROWS))


def shared_pairs(left: DataFrame, right: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """(a, b, n_both): owners of left (a, item) and right (b, item) that share items, and how many; rows are distinct.

    Tasks become more as rows do, so what one of them holds of pairs stays the same; pairs are dealt before they are counted.
    """
    left, right = _kept(left.select(a, item)), _kept(right.select(b, item))
    parts = tasks_for(left.sparkSession, left.count() + right.count())
    pairs = left.repartition(parts, item).join(right.repartition(parts, item).hint("merge"), item).select(a, b)
    return pairs.repartition(parts, a, b).groupBy(a, b).agg(F.count("*").alias("n_both"))


def greedy_match(pairs: DataFrame, left: str, right: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """One-to-one matching of candidate pairs: the first pair in order is taken, both its ends go, and so on.

    Runs in rounds, each written to a table: pairs that are first in order for both their ends are taken, as nothing
    before them can claim an end, and all pairs of their ends go. Where that frees few pairs (long chains, many ties),
    the next round takes the first AT_ONCE of all pairs one after another, so no task holds more. Ends with the same
    identifier but different `within` columns are different. Nulls come last in order; pairs that are equal in order
    are taken by their ends.
    """
    own = list(within)
    ends = [F.struct(*own, left).alias("_left"), F.struct(*own, right).alias("_right")]
    rank = F.struct(*[x.alias(f"{kind}{k}") for k, c in enumerate([*order, *own, left, right]) for kind, x in (("n", F.col(c).isNull()), ("v", F.col(c)))]).alias("_rank")
    now = _kept(pairs.select("*", *ends, rank))
    many, slow, taken = now.count(), False, []
    while many:
        won = _kept(_first_in_turn(now) if slow or many <= AT_ONCE else _first_for_both(now))
        taken.append(won.select(*pairs.columns))
        if many <= AT_ONCE:
            break
        now = _kept(now.join(won.select("_left"), "_left", "left_anti").join(won.select("_right"), "_right", "left_anti").select(now.columns))
        rest = now.count()
        slow, many = not slow and rest > 0.75 * many, rest
    return reduce(DataFrame.unionByName, taken) if taken else now.select(*pairs.columns)


def _first_for_both(pairs: DataFrame) -> DataFrame:
    """The pairs that are first in order for their left and for their right end."""
    first = [pairs.groupBy(end).agg(F.min("_rank").alias("_rank")).select("_rank") for end in ("_left", "_right")]
    return pairs.join(first[0].join(first[1], "_rank"), "_rank", "left_semi").select(pairs.columns).dropDuplicates(["_left", "_right"])


def _first_in_turn(pairs: DataFrame) -> DataFrame:
    """What the first AT_ONCE pairs in order give, taken one after another in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts, rights = set(), set()
        for batch in batches:
            keep = []
            for a, b in zip(*(map(str, batch.column(end).to_pylist()) for end in ("_left", "_right")), strict=True):
                free = a not in lefts and b not in rights
                keep.append(free)
                if free:
                    lefts.add(a)
                    rights.add(b)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return pairs.orderBy("_rank").limit(AT_ONCE).coalesce(1).sortWithinPartitions("_rank").mapInArrow(run, pairs.schema)
