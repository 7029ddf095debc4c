"""Mixing overlapping sources to target weights by a min-cost flow over membership patterns.

1. Documents are sized and summed by membership pattern, the sorted set of sources a document belongs to. Patterns are
   few; more than MOST_PATTERNS is an error, not a silent cap.
2. targets(): the budget is shared by weight, no source above `most` times its size.
3. flow(): each pattern has arcs of its size for its first use, its second and so on, of growing cost, and free arcs to
   its sources, which take up to their targets. The cost of an arc depends only on how often a pattern was used, so the
   cheapest augmenting path is always one from the least used pattern that still has one.
4. selected(): a pattern's flow covers all its documents some times over; the rest is filled in the order of a seeded
   hash. The place in that order where the rest ends is narrowed down bucket by bucket with sums per bucket, so a
   pattern with a third of all documents is never ordered in one task. The document at that place gives its first words.

A null text has size 0 and is never taken. Null sources are a source of their own, ordered last. A document without an
identifier is drawn by its text. Repeated rows, and rows that share an identifier, are documents of their own; ties of the
hash are ordered by identifier and size. An empty table gives an empty mix. Columns with other meanings are not looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

MOST_PATTERNS = 100_000
#: The hash has 60 bits; each narrowing looks at this many of them, so many times.
BITS, LEVELS = 10, 3
_HASH_BITS = 60


def words(text: str = "text") -> Column:
    """How many runs of anything but ASCII white space a text has."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """Shares of share * sum(sizes) by weight; none above most times its size, the excess shared anew by weight."""
    caps = [most * x for x in sizes]
    order = sorted(range(len(sizes)), key=lambda k: (caps[k] / weights[k], k))
    left, weight = share * sum(sizes), sum(weights)
    level = 0.0
    for k in order:
        level = left / weight
        if caps[k] / weights[k] >= level:
            break
        left, weight = left - caps[k], weight - weights[k]
        level = float("inf")
    return [min(c, w * level) for c, w in zip(caps, weights, strict=True)]


def flow(sizes: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], most: int) -> list[dict[int, int]]:
    """For each pattern, what it gives to each of its sources: as much as quotas allow in all, at the least cost.

    sizes and members: words and sources of each pattern; quotas: of each source. The r-th use of a word costs more than
    the one before, so words are used a second time only when no other way to fill a quota is left.
    """
    given: list[dict[int, int]] = [{} for _ in sizes]
    need = list(quotas)
    givers: list[set[int]] = [set() for _ in quotas]
    for _ in range(most):  # one use after another: the order of the costs
        spare = list(sizes)
        blocked: set[int] = set()  # a pattern from which no quota can be reached stays so
        for p in range(len(sizes)):
            while spare[p] and p not in blocked:
                path = _path(p, members, need, given, givers)
                if path is None:
                    blocked.add(p)
                    break
                steps, source = path
                amount = min([spare[p], need[source], *(given[q][s] for q, s, _ in steps[1:])])
                for q, back, ahead in steps:
                    if back is not None:
                        given[q][back] -= amount
                        if not given[q][back]:
                            del given[q][back]
                            givers[back].discard(q)
                    given[q][ahead] = given[q].get(ahead, 0) + amount
                    givers[ahead].add(q)
                spare[p] -= amount
                need[source] -= amount
    return given


def _path(start: int, members: Sequence[Sequence[int]], need: list[int], given: list[dict[int, int]], givers: list[set[int]]):
    """A shortest augmenting path from a pattern: its (pattern, source given up, source given to) and the last source."""
    came: dict[int, tuple[int, int | None]] = {}  # source: (pattern that gives to it, source it gives up)
    queue = deque([(start, None)])
    seen = {start}
    while queue:
        p, back = queue.popleft()
        for s in members[p]:
            if s in came:
                continue
            came[s] = (p, back)
            if need[s] > 0:
                steps, at = [], s
                while at is not None:
                    q, up = came[at]
                    steps.append((q, up, at))
                    at = up
                return steps[::-1], s
            for q in sorted(givers[s] - seen):
                seen.add(q)
                queue.append((q, s))
    return None


def narrowed(sized: DataFrame, wanted: list[tuple[int, int, int]]) -> DataFrame:
    """(pattern, full, rest, prefix): full uses of each pattern's documents, and the bucket of the hash in which rest words
    more end (-1: no rest). sized: pattern, size, h. wanted: (pattern, full uses, words more) of each pattern."""
    spark = sized.sparkSession
    state = [(p, full, rest, -1) for p, full, rest in wanted]
    cut = "pattern int, full long, rest long, prefix long"
    for bits in range(BITS, BITS * LEVELS + 1, BITS):
        bucket = F.shiftright("h", _HASH_BITS - bits)
        plan = F.broadcast(spark.createDataFrame(state, cut))  # a row for each pattern
        inside = sized.join(plan, "pattern").where("rest > 0 and size > 0")
        inside = inside.where((F.col("prefix") < 0) | (F.shiftright("h", _HASH_BITS - bits + BITS) == F.col("prefix")))
        sums = inside.groupBy("pattern", "full", "rest", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        after = F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        found = sums.withColumn("after", after).where("after >= rest and after - n < rest")
        now = {x.pattern: x for x in found.collect()}  # one bucket for each pattern
        # what lies before the bucket is taken whole, so the rest shrinks by it
        state = [(p, full, now[p].rest - (now[p].after - now[p].n), now[p].bucket) if p in now else (p, full, 0, prefix) for p, full, rest, prefix in state]
    return spark.createDataFrame(state, cut)


def selected(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """sized (pattern, size, h, doc_id and others) with taken, under the plan of narrowed(). Rows stay where they are, but
    for those of the last bucket of each pattern."""
    joined = sized.join(F.broadcast(plan), "pattern", "left")
    place = F.shiftright("h", _HASH_BITS - BITS * LEVELS)
    edge = (F.col("prefix") >= 0) & (place == F.col("prefix")) & (F.col("size") > 0)
    whole = F.col("full") * F.col("size") + F.when((F.col("prefix") >= 0) & (place < F.col("prefix")), F.col("size")).otherwise(0)
    order = Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = joined.where(edge).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("taken", whole + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))).drop("before")
    rest = joined.where(~F.coalesce(edge, F.lit(False))).withColumn("taken", F.coalesce(whole, F.lit(0)))
    return rest.unionByName(last).drop("full", "rest", "prefix")


class Mix:
    """A planned mix of a table of documents: told has a row for each pattern, plan its uses (both None for an empty table)."""

    def __init__(self, docs: DataFrame, sources: Column | None, weights: Sequence[float], share: float, most: int, seed: int, key: str, text: str, source: str):
        spark = docs.sparkSession
        self.member = F.array_sort(F.array_distinct(sources)) if sources is not None else F.array(F.col(source).cast("string"))
        # a missing identifier is drawn by its text, so such documents don't all share one place
        own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
        self.draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, _HASH_BITS // 4), 16, 10).cast("long")
        self.key, self.size = F.col(key).cast("long"), words(text)
        self.rows = saved(docs.select(self.key.alias("doc_id"), self.member.alias("members"), self.size.alias("size"), self.draw.alias("h")), "sizes")
        sums = self.rows.groupBy("members").agg(F.sum("size").alias("n")).limit(MOST_PATTERNS + 1).collect()
        if len(sums) > MOST_PATTERNS:
            raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
        self.told = self.plan = None
        if not sums:
            return
        names = sorted({s for x in sums for s in x.members}, key=lambda s: (s is None, s or ""))
        number = {s: k for k, s in enumerate(names)}
        sums = sorted(sums, key=lambda x: [number[s] for s in x.members])
        held = [0] * len(names)
        for x in sums:
            for s in x.members:
                held[number[s]] += x.n
        aims = targets(held, [weights[k % len(weights)] for k in range(len(names))], share, most)
        given = flow([x.n for x in sums], [[number[s] for s in x.members] for x in sums], [int(x + 0.5) for x in aims], most)
        wanted = [(p, *divmod(sum(given[p].values()), x.n)) if x.n else (p, 0, 0) for p, x in enumerate(sums)]
        told = [(p, x.members, held[number[x.members[0]]], float(aims[number[x.members[0]]])) for p, x in enumerate(sums) if x.members]
        self.told = F.broadcast(spark.createDataFrame(told, "pattern int, held_by array<string>, source_size long, target double"))  # a row for each pattern
        self.plan = narrowed(self.named(self.rows), wanted)

    def named(self, rows: DataFrame) -> DataFrame:
        """rows (members and others) with their pattern's number, source_size and target."""
        return rows.join(self.told, F.col("members").eqNullSafe(F.col("held_by"))).drop("held_by")


def mixed(
    docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """doc_id, members, size, source_size, target, taken of every row; weights repeat over the sources in their order.

    sources: an array column where documents belong to several sources; by default each has the one in column source.
    source_size and target are those of the first source in members.
    """
    mix = Mix(docs, sources, weights, share, most, seed, key, text, source)
    if mix.plan is None:
        return mix.rows.select("doc_id", "members", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken"))
    return selected(mix.named(mix.rows), mix.plan).select("doc_id", "members", "size", "source_size", "target", "taken")


def repeated(
    docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17,
    key: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix uses it; the one at which a pattern's words run out is rounded.

    Every row is decided where it stands, so texts are not shuffled and rows that share an identifier are told apart.
    """
    mix = Mix(docs, sources, weights, share, most, seed, key, text, source)
    if mix.plan is None:
        return docs
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), mix.key.alias("doc_id"), mix.member.alias("members"), mix.size.alias("size"), mix.draw.alias("h"))
    rows = selected(mix.named(rows), mix.plan).where("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    return rows.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times)).alias("use")).select("row.*")
