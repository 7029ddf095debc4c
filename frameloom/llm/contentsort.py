"""Exact deduplication by content sort, with DataFrame functions only.

Rows are range-partitioned by sampled splitters over (leading bytes, digest, salt) of the normalised text; the external
sort of each partition then places equal texts side by side, and each row is compared in full with the one before it.
Runs of equal rows get the identifier that stays and the number of rows.

A text that makes up a large share of a sample (a quarter of a task's part, so the more tasks, the smaller the share) is
dealt over many tasks by a salt of the identifier; its runs are put together afterwards in a table with a row per run.
The share bounds the number of such texts by four for each task, and changes only where rows are sorted.

Null texts count as empty, and all empty texts are equal; very long texts are compared whole. Of rows that share the
largest (or smallest) identifier and the text, all carry that identifier and count as kept. An empty table gives no rows.
Columns with other meanings are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, shuffle_width

#: Rows of a frequent text that a sample should hold, and the part of a task's share from which a text is salted.
SEEN, HOT_PART = 40, 0.25
#: Leading bytes that are compared before the digest.
LEAD = 24

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased only. lower() does just that for ASCII texts, and quickly."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def frequent_digests(keyed: DataFrame, rows: int, width: int) -> list[str]:
    """Digests with at least HOT_PART of a task's share of a sample of the rows; width / HOT_PART at most."""
    share = HOT_PART / width
    asked = max(40_000, int(SEEN / share))
    sample = keyed.select("norm").sample(min(1.0, asked / max(rows, 1)), 7)
    counts = sample.groupBy(F.sha2("norm", 256).alias("digest")).agg(F.count("*").alias("n"))
    least = max(20, int(share * min(rows, asked)))
    return [x.digest for x in counts.where(F.col("n") >= least).orderBy(F.desc("n"), "digest").limit(int(1 / share)).collect()]


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. keep: the largest (max) or smallest (min) identifier stays."""
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    width = shuffle_width(docs.sparkSession)
    keyed = docs.select(F.col(key).cast("long").alias("doc_id"), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("norm"))
    hot = frequent_digests(keyed, docs.count(), width)
    keyed = keyed.withColumn("text_sha256", F.sha2("norm", 256)).withColumn("lead", F.substring(F.col("norm").cast("binary"), 1, LEAD))
    salt = F.when(F.col("text_sha256").isin(hot), F.pmod(F.xxhash64("doc_id"), F.lit(width))) if hot else F.lit(None)
    keyed = keyed.withColumn("salt", F.coalesce(salt.cast("int"), F.lit(-1)))
    dealt = keyed.repartitionByRange(width, "lead", "text_sha256", "salt")

    place = Window.partitionBy("lead", "text_sha256", "salt").orderBy("norm")
    before = F.lag("norm").over(place)
    runs = dealt.withColumn("starts", (~F.col("norm").eqNullSafe(before)).cast("int"))
    runs = runs.withColumn("run", F.sum("starts").over(place.rowsBetween(Window.unboundedPreceding, 0))).drop("norm", "starts")

    best = F.max if keep == "max" else F.min
    own = Window.partitionBy("lead", "text_sha256", "salt", "run")
    marked = runs.withColumn("keep_id", best("doc_id").over(own)).withColumn("group_size", F.count("*").over(own))
    if hot:
        # a row for each frequent text, so as many as hot has; its runs in several tasks become one group
        runs = marked = saved(marked.drop("lead"), "copies")
        heads = runs.where("salt >= 0").groupBy("text_sha256", "run").agg(best("doc_id").alias("whole_id"), F.count("*").alias("whole_size"))
        marked = marked.join(F.broadcast(heads), ["text_sha256", "run"], "left")
        marked = marked.withColumn("keep_id", F.when(F.col("salt") >= 0, F.col("whole_id")).otherwise(F.col("keep_id")))
        marked = marked.withColumn("group_size", F.when(F.col("salt") >= 0, F.col("whole_size")).otherwise(F.col("group_size")))
    return marked.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """One row of docs, all columns, for each normalised text: that of the largest (max) or smallest (min) identifier.

    Of rows that share this too, the one with the smallest hash of all columns stays. Copies of frequent texts go before
    the sort: only rows with the identifier that stays are left of those. A missing identifier stays only if all are missing.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is max or min")
    width = shuffle_width(docs.sparkSession)
    norm = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    hot = frequent_digests(docs.select(norm.alias("norm")), docs.count(), width)
    # the row goes along as one column, so that no name can clash
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), norm.alias("norm"), F.col(key).cast("long").alias("id")).withColumn("digest", F.sha2("norm", 256))
    if hot:
        best = F.max if keep == "max" else F.min
        frequent = keyed.where(F.col("digest").isin(hot)).groupBy("digest", "norm").agg(best("id").alias("best"))
        # as many rows as hot has, give or take digests that two texts share
        first = F.broadcast(frequent.select(F.col("digest").alias("of"), "best").where("best is not null"))
        keyed = keyed.join(first, F.col("digest") == F.col("of"), "left").where("of is null or id = best").drop("of", "best")
    keyed = keyed.withColumn("lead", F.substring(F.col("norm").cast("binary"), 1, LEAD))
    dealt = keyed.repartitionByRange(width, "lead", "digest")
    order = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()
    before = F.lag("norm").over(Window.partitionBy("lead", "digest").orderBy("norm", order, F.xxhash64("row")))
    return dealt.withColumn("copy", F.col("norm").eqNullSafe(before)).where("not copy").select("row.*")
