"""Queries over the driver's tables, one or more for each family of operators, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as X
from ..graph import _kept, connected_components
from ..operators import active, activity, annotations, candidates, detection, diagnostics, evidence, images, joins, proposals, regions, review, scans, scoring, signal
from ..session import workers_import_this
from .tables import DAYS, EVENTS_SQL, HOURS, events, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; sql may use the common table expression e of EVENTS_SQL as {e}."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(workers_import_this(spark), sf_dir)
        if sql:
            SQL[f.__name__] = sql.replace("{e}", EVENTS_SQL)
        return f

    return put


# --- rasters and population activity ---


@query("""WITH {e}, o AS (SELECT DISTINCT user_id FROM e), g AS (SELECT user_id, b AS bin FROM o, range(30) t(b)),
    c AS (SELECT user_id, day AS bin, count(*) AS n FROM e WHERE day BETWEEN 0 AND 29 GROUP BY ALL)
    SELECT user_id, g.bin::INT AS bin, coalesce(n, 0) AS n_events FROM g LEFT JOIN c USING (user_id, bin)""")
def event_raster(spark: SparkSession, d: str) -> DataFrame:
    return activity.event_raster(events(spark, d), HOURS, 24, "user_id", "hour")


@query("""WITH {e}, o AS (SELECT count(DISTINCT user_id) AS n FROM e),
    c AS (SELECT day, count(*) AS total, count(DISTINCT user_id) AS active FROM e WHERE day BETWEEN 0 AND 29 GROUP BY day),
    g AS (SELECT b::INT AS bin, coalesce(total, 0) AS total_events, coalesce(active, 0) AS active_objects FROM range(30) t(b) LEFT JOIN c ON day = b)
    SELECT bin, total_events, active_objects, active_objects / o.n AS active_fraction,
           CASE WHEN active_objects = 0 THEN 0.0 ELSE total_events / active_objects END AS mean_per_active, (active_objects >= 2)::INT AS coactive,
           (row_number() OVER (ORDER BY total_events DESC, bin) = 1)::INT AS is_peak FROM g, o""")
def population_activity(spark: SparkSession, d: str) -> DataFrame:
    return activity.population_activity(events(spark, d), HOURS, 24, "user_id", "hour")


@query("""WITH {e}, v AS (SELECT event_type AS o, day, count(*)::DOUBLE AS v FROM e WHERE day BETWEEN 0 AND 29 GROUP BY ALL),
    s AS (SELECT o, sum(v) AS s, sum(v * v) AS ss FROM v GROUP BY o),
    p AS (SELECT x.o AS a, y.o AS b, sum(x.v * y.v) AS sxy FROM v x JOIN v y USING (day) WHERE x.o < y.o GROUP BY ALL),
    r AS (SELECT a.o AS a, b.o AS b, 30 * coalesce(sxy, 0) - a.s * b.s AS top, sqrt(greatest(0, (30 * a.ss - a.s * a.s) * (30 * b.ss - b.s * b.s))) AS below
          FROM s a JOIN s b ON a.o < b.o LEFT JOIN p ON p.a = a.o AND p.b = b.o)
    SELECT a, b, round(CASE WHEN below = 0 THEN 0 ELSE top / below END, 9) AS r, (below > 0)::INT AS defined FROM r""")
def event_correlation(spark: SparkSession, d: str) -> DataFrame:
    rows = activity.in_range(events(spark, d), DAYS, "day").withColumn("one", F.lit(1.0))
    return activity.correlation(rows, "event_type", "day", "one", DAYS).withColumn("r", F.round("r", 9))


@query("""WITH x AS (SELECT label, k AS pos, avg(embedding[k]::DOUBLE) AS v FROM embeddings, range(1, 65) t(k) GROUP BY ALL),
    s AS (SELECT label, sum(v) AS s, sum(v * v) AS ss FROM x GROUP BY label),
    p AS (SELECT a.label AS a, b.label AS b, sum(a.v * b.v) AS sxy FROM x a JOIN x b USING (pos) WHERE a.label < b.label GROUP BY ALL)
    SELECT p.a, p.b, round((64 * sxy - a.s * b.s) / sqrt((64 * a.ss - a.s * a.s) * (64 * b.ss - b.s * b.s)), 6) AS r, 1 AS defined
    FROM p JOIN s a ON p.a = a.label JOIN s b ON p.b = b.label""")
def trace_correlation(spark: SparkSession, d: str) -> DataFrame:
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("at", "v"))
    mean = long.groupBy("label", "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return activity.correlation(mean, "label", "at", "v", 64).withColumn("r", F.round("r", 6))


# --- matching of events and detections ---

_GT = "gt AS (SELECT hour AS frame, event_id AS gt_id, value AS x, (user_id % 20)::DOUBLE AS y FROM e WHERE event_type = 'purchase')"
_DET = "det AS (SELECT hour AS frame, event_id AS det_idx, value AS x, (user_id % 20)::DOUBLE AS y, k::DOUBLE AS z, event_type FROM e WHERE event_type IN ('click', 'view'))"
_THRESHOLDS = (90.0, 75.0, 50.0, 25.0, 10.0, 0.0)
_SWEEP = f"""{{e}}, {_GT}, {_DET}, t AS (SELECT unnest([90.0, 75.0, 50.0, 25.0, 10.0, 0.0])::DOUBLE AS threshold),
    c AS (SELECT threshold, event_type, frame, gt_id, min(det_idx) AS det_idx FROM gt JOIN det USING (frame), t
          WHERE sqrt((gt.x - det.x) ** 2 + (gt.y - det.y) ** 2) <= 5 AND z >= threshold GROUP BY ALL),
    h AS (SELECT threshold, event_type, count(*) AS tp, count(DISTINCT det_idx) AS credited FROM c GROUP BY ALL),
    n AS (SELECT threshold, event_type, count(*) FILTER (z >= threshold) AS n_det FROM det, t GROUP BY ALL),
    sweep AS (SELECT threshold, event_type, coalesce(tp, 0) AS tp, n_det - coalesce(credited, 0) AS fp, (SELECT count(*) FROM gt) - coalesce(tp, 0) AS fn,
              coalesce(tp, 0) / (SELECT count(*) FROM gt) AS tpr, (n_det - coalesce(credited, 0)) / 720.0::DOUBLE AS fppi
              FROM n LEFT JOIN h USING (threshold, event_type))"""


def _second() -> Column:
    """The second coordinate of a place."""
    return (F.col("user_id") % 20).cast("double").alias("y")


def _truth(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type = 'purchase'").select(F.col("hour").alias("frame"), F.col("event_id").alias("gt_id"), F.col("value").alias("x"), _second())


def _detections(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type in ('click', 'view')")
    return rows.select(F.col("hour").alias("frame"), F.col("event_id").alias("det_idx"), F.col("value").alias("x"), _second(), F.col("k").cast("double").alias("z"), "event_type")


def _sweep(spark: SparkSession, d: str) -> DataFrame:
    return detection.froc_sweep(_truth(spark, d), _detections(spark, d), _THRESHOLDS, 5.0, HOURS, ["event_type"])


@query(f"WITH {_SWEEP} SELECT * FROM sweep")
def froc_sweep(spark: SparkSession, d: str) -> DataFrame:
    return _sweep(spark, d)


@query(f"""WITH {_SWEEP}, i AS (SELECT event_type, fppi, tpr FROM sweep WHERE fppi <= 2 QUALIFY row_number() OVER (PARTITION BY event_type, fppi ORDER BY threshold DESC) = 1),
    x AS (SELECT * FROM i UNION ALL SELECT event_type, 0.0, 0.0 FROM i GROUP BY 1 HAVING min(fppi) > 0
          UNION ALL SELECT event_type, 2.0, max_by(tpr, fppi) FROM i GROUP BY 1 HAVING max(fppi) < 2),
    s AS (SELECT event_type, (fppi - lag(fppi) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS piece FROM x WINDOW w AS (PARTITION BY event_type ORDER BY fppi)),
    a AS (SELECT event_type, sum(piece) AS auc FROM s GROUP BY 1)
    SELECT DISTINCT sweep.event_type, round(coalesce(auc, 0), 9) AS auc FROM sweep LEFT JOIN a USING (event_type)""")
def truncated_auc(spark: SparkSession, d: str) -> DataFrame:
    return detection.truncated_auc(_sweep(spark, d), 2.0, ["event_type"]).withColumn("auc", F.round("auc", 9))


@query(f"""WITH {_SWEEP}, b AS (SELECT *, tpr - fppi / 10.0::DOUBLE AS balance FROM sweep QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY balance DESC, threshold DESC) = 1)
    SELECT *, row_number() OVER (ORDER BY balance DESC, event_type) AS place FROM b""")
def operating_points(spark: SparkSession, d: str) -> DataFrame:
    return detection.operating_points(_sweep(spark, d), 10.0, ["event_type"]).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {{e}}, {_GT}, {_DET}, p AS (SELECT gt_id, max(z) AS best_z FROM gt JOIN det USING (frame) WHERE sqrt((gt.x - det.x) ** 2 + (gt.y - det.y) ** 2) <= 5 GROUP BY gt_id)
    SELECT gt.gt_id, best_z FROM (SELECT DISTINCT gt_id FROM gt) gt LEFT JOIN p USING (gt_id)""")
def coverage_threshold(spark: SparkSession, d: str) -> DataFrame:
    return detection.coverage_threshold(_truth(spark, d), _detections(spark, d), 5.0)


@query("""WITH {e}, o AS (SELECT DISTINCT user_id, micros AS onset, lead(micros) OVER (PARTITION BY user_id ORDER BY micros) AS next FROM e WHERE event_type = 'signup'),
    f AS (SELECT o.user_id, onset, min(micros) AS found FROM o LEFT JOIN e ON e.user_id = o.user_id AND event_type = 'click' AND micros >= onset AND (next IS NULL OR micros < next) GROUP BY ALL)
    SELECT user_id, onset, found, found - onset AS latency FROM f""")
def detection_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return detection.detection_latency(rows.where("event_type = 'signup'"), rows.where("event_type = 'click'"), "user_id", "micros")


@query("""WITH {e}, g AS (SELECT user_id, micros, max(value) AS x, max(k)::DOUBLE AS y FROM e WHERE event_type = 'view' GROUP BY ALL), o AS (SELECT user_id, min(micros) AS onset FROM g GROUP BY 1),
    d AS (SELECT user_id, micros, value AS dx, k::DOUBLE AS dy FROM e WHERE event_type = 'click'), h AS (SELECT d.*, x, y FROM d ASOF JOIN g ON d.user_id = g.user_id AND d.micros >= g.micros),
    f AS (SELECT user_id, min(micros) AS found FROM h WHERE sqrt((dx - x) ** 2 + (dy - y) ** 2) <= 30 GROUP BY 1)
    SELECT o.user_id, onset, found, found - onset AS latency FROM o LEFT JOIN f USING (user_id)""")
def located_latency(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumns({"x": F.col("value"), "y": F.col("k").cast("double")})
    truth = rows.where("event_type = 'view'").groupBy("user_id", "micros").agg(F.max("x").alias("x"), F.max("y").alias("y"))
    return detection.located_latency(truth, rows.where("event_type = 'click'"), "user_id", "micros", 30.0)


@query("""WITH {e}, s AS (SELECT user_id, micros, value AS last_value FROM e WHERE event_type = 'view'), p AS (SELECT event_id, user_id, micros FROM e WHERE event_type = 'purchase')
    SELECT event_id, p.user_id, p.micros, s.last_value FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.micros >= s.micros""")
def asof_last_view(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    views = rows.where("event_type = 'view'").select("user_id", "micros", F.col("value").alias("last_value"))
    return joins.asof_backward(rows.where("event_type = 'purchase'").select("event_id", "user_id", "micros"), views, ["user_id"], "micros", ["last_value"])


@query("""WITH {e}, s AS (SELECT user_id, micros, value AS last_value FROM e WHERE event_type = 'view'), p AS (SELECT event_id, user_id, micros FROM e WHERE event_type = 'purchase')
    SELECT event_id, p.user_id, p.micros, s.last_value FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.micros >= s.micros""")
def asof_by_range(spark: SparkSession, d: str) -> DataFrame:
    """As asof_last_view, in ranges of two days that carry their last value on."""
    rows = events(spark, d)
    views = rows.where("event_type = 'view'").select("user_id", "micros", F.col("value").alias("last_value"))
    return joins.asof_by_range(rows.where("event_type = 'purchase'").select("event_id", "user_id", "micros"), views, ["user_id"], "micros", ["last_value"], 2 * 86_400_000_000)


_WILD = """g AS (SELECT event_id AS gt_id, CASE WHEN user_id % 10 = 0 THEN '' ELSE (user_id % 50)::VARCHAR END AS gt_object, hour AS gt_onset, hour + k % 4 AS gt_peak, k % 5 AS gt_duration FROM e WHERE event_type = 'purchase'),
    c AS (SELECT event_id AS cand_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE (user_id % 50)::VARCHAR END AS cand_object, hour AS cand_onset, hour + k % 3 AS cand_peak, k % 6 AS cand_duration FROM e WHERE event_type = 'signup'),
    p AS (SELECT gt_id, cand_id, cand_onset - gt_onset AS onset_error, cand_peak - gt_peak AS peak_error, cand_duration - gt_duration AS duration_error FROM g JOIN c
          ON abs(cand_onset - gt_onset) <= 2 AND (gt_object = '' OR cand_object IS NULL OR gt_object = cand_object))"""


def _wild(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Purchases and signups as events of objects, some of which are not named."""
    rows, name = events(spark, d), (F.col("user_id") % 50).cast("string")
    side = lambda kind, c, blank, every, peak, length: rows.where(F.col("event_type") == kind).select(
        F.col("event_id").alias(f"{c}_id"), F.when(F.col("user_id") % every == 0, blank).otherwise(name).alias(f"{c}_object"), F.col("hour").alias(f"{c}_onset"),
        (F.col("hour") + F.col("k") % peak).alias(f"{c}_peak"), (F.col("k") % length).alias(f"{c}_duration"),
    )
    return side("purchase", "gt", F.lit(""), 10, 4, 5), side("signup", "cand", F.lit(None), 7, 3, 6)


@query(f"WITH {{e}}, {_WILD} SELECT gt_id, cand_id, onset_error, peak_error, duration_error FROM p")
def event_wildcard_pairs(spark: SparkSession, d: str) -> DataFrame:
    truth, found = _wild(spark, d)
    pairs = joins.event_pairs(truth, found, "gt_object", "cand_object", [("gt_onset", "cand_onset", 2)])
    return pairs.select("gt_id", "cand_id", *[(F.col(f"cand_{c}") - F.col(f"gt_{c}")).alias(f"{c}_error") for c in ("onset", "peak", "duration")])


@query(f"""WITH RECURSIVE {{e}}, {_WILD}, q AS (SELECT *, row_number() OVER (ORDER BY abs(onset_error), abs(peak_error), gt_id, cand_id) AS k FROM p),
    r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gs, []::BIGINT[] AS cs UNION ALL
          SELECT n.k, list_append(r.gs, n.gt_id), list_append(r.cs, n.cand_id) FROM r, LATERAL (SELECT k, gt_id, cand_id FROM q WHERE q.k > r.k AND NOT list_contains(r.gs, gt_id) AND NOT list_contains(r.cs, cand_id) ORDER BY q.k LIMIT 1) n),
    l AS (SELECT gs, cs FROM r ORDER BY k DESC LIMIT 1), m AS (SELECT unnest(gs) AS gt_id, unnest(cs) AS cand_id FROM l)
    SELECT p.* FROM p JOIN m USING (gt_id, cand_id)""")
def event_wildcard_matches(spark: SparkSession, d: str) -> DataFrame:
    return joins.match_events(*_wild(spark, d), tolerance=2)


@query("""WITH {e}, c AS (SELECT count(*) AS total FROM e WHERE event_type = 'click'),
    n AS (SELECT count(*) AS near FROM e c WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM e x WHERE x.event_type = 'error' AND x.hour = c.hour AND sqrt((x.value - c.value) ** 2 + (x.user_id % 20 - c.user_id % 20) ** 2) <= 6.75))
    SELECT 'structure' AS category, near AS n, 100.0::DOUBLE * (near / total) AS percentage FROM c, n UNION ALL SELECT 'isolated', total - near, 100.0::DOUBLE * ((total - near) / total) FROM c, n""")
def false_positive_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.col("hour").alias("frame"), F.col("event_id").alias("det_idx"), F.col("value").alias("x"), _second(), "event_type")
    return detection.false_positive_taxonomy(rows.where("event_type = 'click'"), rows.where("event_type = 'error'"), 6.75)


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    gt = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("gt_id"), F.col("micros").alias("gt_at"))
    found = rows.where("event_type = 'click'").select("user_id", F.col("event_id").alias("cand_id"), F.col("micros").alias("cand_at"))
    pairs = joins.binned_join(gt, found, ["user_id"], [("gt_at", "cand_at", 6 * 3_600_000_000)])
    return pairs.select("user_id", "gt_id", "cand_id", F.abs(F.col("gt_at") - F.col("cand_at")).alias("apart"))


@query("""WITH {e} SELECT g.user_id, g.event_id AS gt_id, c.event_id AS cand_id, abs(g.micros - c.micros) AS apart FROM e g JOIN e c USING (user_id)
    WHERE g.event_type = 'purchase' AND c.event_type = 'click' AND abs(g.micros - c.micros) <= 21600000000""")
def event_match_eligible(spark: SparkSession, d: str) -> DataFrame:
    return _eligible(spark, d)


_GREEDY = """p AS (SELECT g.user_id, g.event_id AS gt_id, c.event_id AS cand_id, abs(g.micros - c.micros) AS apart FROM e g JOIN e c USING (user_id)
    WHERE g.event_type = 'purchase' AND c.event_type = 'click' AND abs(g.micros - c.micros) <= 21600000000),
    q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY apart, gt_id, cand_id) AS k FROM p),
    r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, []::BIGINT[] AS gs, []::BIGINT[] AS cs FROM q
          UNION ALL SELECT q.user_id, q.k, CASE WHEN list_contains(gs, gt_id) OR list_contains(cs, cand_id) THEN gs ELSE list_append(gs, gt_id) END,
          CASE WHEN list_contains(gs, gt_id) OR list_contains(cs, cand_id) THEN cs ELSE list_append(cs, cand_id) END FROM r JOIN q ON q.user_id = r.user_id AND q.k = r.k + 1),
    l AS (SELECT user_id, arg_max(gs, k) AS gs, arg_max(cs, k) AS cs FROM r GROUP BY 1), m AS (SELECT user_id, unnest(gs) AS gt_id, unnest(cs) AS cand_id FROM l)"""


@query(f"WITH RECURSIVE {{e}}, {_GREEDY} SELECT p.user_id, p.gt_id, p.cand_id, apart FROM p JOIN m ON m.gt_id = p.gt_id AND m.cand_id = p.cand_id")
def event_match_greedy(spark: SparkSession, d: str) -> DataFrame:
    return joins.greedy_match(_eligible(spark, d), "gt_id", "cand_id", ["apart", "gt_id", "cand_id"], ["user_id"])


@query("""WITH {e}, g AS (SELECT user_id, event_id AS gt_id, micros, row_number() OVER (PARTITION BY user_id, hour // 6 ORDER BY micros, event_id) AS k, hour // 6 AS slot FROM e WHERE event_type = 'purchase'),
    c AS (SELECT user_id, event_id AS cand_id, micros, row_number() OVER (PARTITION BY user_id, hour // 6 ORDER BY micros, event_id) AS k, hour // 6 AS slot FROM e WHERE event_type = 'click'),
    p AS (SELECT g.gt_id, c.cand_id, g.k AS gk, c.k AS ck, (c.micros - g.micros) / 1000000.0::DOUBLE AS error FROM g JOIN c USING (user_id, slot)), m AS (SELECT * FROM p WHERE gk = ck),
    bg AS (SELECT gt_id, count(DISTINCT cand_id) AS n FROM p GROUP BY 1), bc AS (SELECT cand_id, count(DISTINCT gt_id) AS n FROM p GROUP BY 1),
    r AS (SELECT (SELECT count(*) FROM g) AS count_gt, (SELECT count(*) FROM c) AS count_candidate, (SELECT count(*) FROM m) AS "TP", round((SELECT avg(error) FROM m), 6) AS mean_error, round((SELECT avg(abs(error)) FROM m), 6) AS mean_abs_error,
    (SELECT count(*) FROM bc WHERE cand_id NOT IN (SELECT cand_id FROM m)) AS duplicate_candidate_count, (SELECT count(*) FROM bg WHERE n > 1) AS split_ground_truth_count, (SELECT count(*) FROM bc WHERE n > 1) AS merged_candidate_count)
    SELECT *, count_candidate - "TP" AS "FP", count_gt - "TP" AS "FN", round("TP" / count_candidate, 9) AS precision, round("TP" / count_gt, 9) AS recall, round(duplicate_candidate_count / count_candidate, 9) AS duplicate_rate,
    round(split_ground_truth_count / count_gt, 9) AS split_rate, round(merged_candidate_count / count_candidate, 9) AS merge_rate FROM r""")
def match_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Purchases against clicks of the same user and six hours, the n-th with the n-th."""
    rows = events(spark, d).withColumn("slot", F.floor(F.col("hour") / 6))
    place = F.row_number().over(Window.partitionBy("user_id", "slot").orderBy("micros", "event_id"))
    side = lambda kind, key, at, k: rows.where(F.col("event_type") == kind).select("user_id", "slot", F.col("event_id").alias(key), F.col("micros").alias(at), place.alias(k))
    gt, found = side("purchase", "gt_id", "gt_at", "gk"), side("click", "cand_id", "cand_at", "ck")
    pairs = gt.join(found, ["user_id", "slot"]).withColumn("error", (F.col("cand_at") - F.col("gt_at")) / 1e6)
    out = detection.match_metrics(gt, found, pairs, pairs.where("gk = ck"), "gt_id", "cand_id", ["error"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_error", "mean_abs_error")} | {c: F.round(c, 9) for c in ("precision", "recall", "duplicate_rate", "split_rate", "merge_rate")})


# --- candidates ---

_FEATURES = """f AS (SELECT p_partkey, p_retailprice - 900 AS raw_score, p_size::DOUBLE AS peak_z, count(l_orderkey) AS event_count, coalesce(avg(l_quantity), 0) / 10 AS trace_snr,
    coalesce(avg(l_discount), 0) AS local_correlation, coalesce(max(l_tax), 0) AS event_support, coalesce(avg((l_returnflag = 'R')::INT), 0) AS artifact_score
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)"""
_SCORE = """raw_score + 0.2 * greatest(0, least(12, peak_z)) + 0.45 * greatest(0, least(8, event_count)) + 0.25 * greatest(0, least(6, trace_snr))
    + 0.2 * greatest(0, least(1, local_correlation)) + 0.2 * greatest(0, least(1, event_support)) - 0.15 * artifact_score - 0.05 * (peak_z <= 2)::INT"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("event_count"), F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("local_correlation"), F.max("l_tax").alias("event_support"),
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("artifact_score"),
    )
    rows = table(spark, d, "part").join(items, F.col("l_partkey") == F.col("p_partkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return rows.select(
        "p_partkey", (F.col("p_retailprice") - 900).alias("raw_score"), F.col("p_size").cast("double").alias("peak_z"), F.coalesce("event_count", F.lit(0)).alias("event_count"),
        (F.coalesce("q", F.lit(0.0)) / 10).alias("trace_snr"), zero("local_correlation"), zero("event_support"), zero("artifact_score"),
    )


@query(f"WITH {_FEATURES} SELECT p_partkey, raw_score, peak_z, event_count, round(trace_snr, 9) AS trace_snr, round(local_correlation, 9) AS local_correlation, event_support, round(artifact_score, 9) AS artifact_score FROM f")
def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    return _features(spark, d).withColumns({c: F.round(c, 9) for c in ("trace_snr", "local_correlation", "artifact_score")})


@query(f"WITH {_FEATURES}, v AS (SELECT p_partkey, CASE WHEN event_count = 0 THEN 'missing' END AS problem FROM f) SELECT p_partkey, 'trace_snr' AS \"column\", problem FROM v WHERE problem IS NOT NULL")
def feature_violations(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d).withColumn("trace_snr", F.when(F.col("event_count") > 0, F.col("trace_snr")))
    return candidates.violations(rows, ["raw_score", "peak_z", "trace_snr", "artifact_score"], "p_partkey")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d)
    score = candidates.priority({c: F.col(c) for c in candidates.PRIORITY_TERMS}, F.col("peak_z"))
    return candidates.ranked(rows.withColumn("score", X.rounded(score, 6)).select("p_partkey", "score"), "score", "p_partkey")


@query(f"WITH {_FEATURES}, s AS (SELECT p_partkey, round({_SCORE}, 6) AS score FROM f) SELECT *, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank FROM s")
def candidate_rank(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


def _links(spark: SparkSession, d: str) -> DataFrame:
    return candidates.near_links(table(spark, d, "supplier").withColumn("x", F.col("s_acctbal")).withColumn("y", F.col("s_nationkey").cast("double")), "s_suppkey", "x", "y", 25.0)


_LINKS = """l AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b, sqrt(pow(a.s_acctbal - b.s_acctbal, 2) + pow(a.s_nationkey - b.s_nationkey, 2)) AS distance
    FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE sqrt(pow(a.s_acctbal - b.s_acctbal, 2) + pow(a.s_nationkey - b.s_nationkey, 2)) <= 25)"""


@query(f"WITH {_LINKS} SELECT a, b, round(distance, 6) AS distance FROM l")
def candidate_links(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE {_LINKS}, u AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
    r AS (SELECT x AS id, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.id),
    c AS (SELECT id, min(root) AS component FROM r GROUP BY id)
    SELECT component, count(*) AS n_members, round(avg(s_acctbal), 6) AS cx, round(avg(s_nationkey::DOUBLE), 6) AS cy, round(sum(s_acctbal), 4) AS total_area,
           round((SELECT min(distance) FROM l JOIN c m ON m.id = l.a WHERE m.component = c.component), 6) AS min_distance,
           (SELECT count(*) FROM l JOIN c m ON m.id = l.a WHERE m.component = c.component) AS n_links
    FROM c JOIN supplier ON s_suppkey = id GROUP BY component""")
def candidate_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").withColumn("y", F.col("s_nationkey").cast("double"))
    out = candidates.near_clusters(rows, "s_suppkey", "s_acctbal", "y", 25.0, "s_acctbal")
    return out.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6), "total_area": F.round("total_area", 4), "min_distance": F.round("min_distance", 6)})


_BOXES = """p AS (SELECT p_partkey AS id, p_retailprice::DOUBLE AS x, (p_size * 4)::DOUBLE AS y, (p_size % 7 + 2)::DOUBLE AS w, (p_size % 5 + 3)::DOUBLE AS h FROM part),
    q AS (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy FROM p),
    n AS (SELECT a.id AS a, b.id AS b, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) AS distance,
          greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS s, a.w * a.h + b.w * b.h AS t
          FROM q a JOIN q b ON a.id < b.id AND abs(a.x - b.x) <= 10 AND abs(a.y - b.y) <= 10),
    l AS (SELECT a, b, distance, s / (t - s) AS iou FROM n WHERE distance <= 2 OR s / (t - s) >= 0.2)"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").cast("double").alias("bbox_x"), (size * 4).cast("double").alias("bbox_y"), (size % 7 + 2).cast("double").alias("bbox_width_px"), (size % 5 + 3).cast("double").alias("bbox_height_px"))
    rows = rows.withColumns({"centroid_x": F.col("bbox_x") + F.col("bbox_width_px") / 2, "centroid_y": F.col("bbox_y") + F.col("bbox_height_px") / 2})
    return rows.withColumn("area_px", F.col("bbox_width_px") * F.col("bbox_height_px"))


@query(f"""WITH {_BOXES} SELECT a, b, round(distance, 6) AS distance, round(iou, 6) AS bbox_iou,
    array_to_string(list_filter([CASE WHEN distance <= 2 THEN 'nearby_centroids' END, CASE WHEN iou >= 0.2 THEN 'overlapping_bboxes' END], lambda x: x IS NOT NULL), ',') AS reasons FROM l""")
def candidate_box_links(spark: SparkSession, d: str) -> DataFrame:
    shown = {"distance": F.round("distance", 6), "bbox_iou": F.round("bbox_iou", 6), "reasons": F.array_join("reasons", ",")}
    return candidates.box_links(_boxes(spark, d), "id", 2.0, 0.2, shown)


@query(f"""WITH RECURSIVE {_BOXES}, u AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), r AS (SELECT x AS id, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.id),
    c AS (SELECT id, min(root) AS component FROM r GROUP BY id),
    m AS (SELECT component, count(*) AS candidate_count, avg(cx) AS cx, avg(cy) AS cy, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height, sum(w * h) AS area, min(w * h) AS lo, max(w * h) AS hi FROM q JOIN c USING (id) GROUP BY 1),
    k AS (SELECT component, max(iou) AS max_iou, min(distance) AS min_distance FROM l JOIN c ON c.id = l.a GROUP BY 1),
    z AS (SELECT *, list_sort(list_filter([CASE WHEN max_iou >= 0.25 THEN 'possible_duplicate' END, CASE WHEN candidate_count >= 3 THEN 'clustered_candidates' END, CASE WHEN min_distance <= 3 THEN 'close_centroids' END,
          CASE WHEN hi >= 1.8 * greatest(1, lo) THEN 'split_merge_review' END], lambda v: v IS NOT NULL)) AS codes FROM m JOIN k USING (component))
    SELECT component, candidate_count, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(x, 6) AS x, round(y, 6) AS y, round(width, 6) AS width, round(height, 6) AS height, round(area, 6) AS area_px_sum, round(max_iou, 6) AS max_iou,
    round(min_distance, 6) AS min_distance, CASE WHEN len(codes) > 0 THEN array_to_string(codes, ',') ELSE 'spatially_related' END AS issue_codes,
    CASE WHEN list_contains(codes, 'possible_duplicate') THEN 'review_duplicate_or_merge' WHEN list_contains(codes, 'split_merge_review') THEN 'review_split_merge' ELSE 'review_cluster_context' END AS suggested_action FROM z""")
def candidate_cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    boxes = _boxes(spark, d)
    out = candidates.box_clusters(boxes, "id", 2.0, 0.2)
    numbers = ("centroid_x", "centroid_y", "x", "y", "width", "height", "area_px_sum", "max_iou", "min_distance")
    return out.withColumns({c: F.round(c, 6) for c in numbers} | {"issue_codes": F.array_join("issue_codes", ",")})


_SUGGESTED = """g AS (SELECT c_custkey AS id, c_acctbal::DOUBLE / 1000 AS priority, (c_custkey % 10) / 10.0::DOUBLE AS lc, (c_custkey % 7) / 7.0::DOUBLE AS es, (c_custkey % 11) / 20.0::DOUBLE AS artifact,
    CASE WHEN c_nationkey % 3 = 0 THEN '' WHEN c_nationkey % 3 = 1 THEN 'missed' ELSE 'artifact' END AS state, CASE WHEN c_nationkey % 5 = 0 THEN 'edge_glow' ELSE 'none' END AS cue FROM customer)"""


def _suggested(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    rows = table(spark, d, "customer").select(
        key.alias("id"), (F.col("c_acctbal").cast("double") / 1000).alias("priority"), (key % 10 / 10.0).alias("local_correlation"), (key % 7 / 7.0).alias("event_support"), (key % 11 / 20.0).alias("artifact_score"),
        F.when(nation % 3 == 0, "").when(nation % 3 == 1, "missed").otherwise("artifact").alias("state"), F.when(nation % 5 == 0, "edge_glow").otherwise("none").alias("cue"), "c_mktsegment",
    )
    return rows, {c: F.col(c) for c in ("priority", "local_correlation", "event_support", "artifact_score")}


@query(f"""WITH {_SUGGESTED} SELECT id, round(priority + 0.8 * lc + 0.8 * es + CASE WHEN state = '' THEN 1.5 ELSE 0 END + CASE WHEN artifact >= 0.4 OR cue <> 'none' THEN 0.7 ELSE 0 END, 6) AS score,
    coalesce(nullif(array_to_string(list_filter([CASE WHEN state = '' THEN 'unlabeled suggestion' END, CASE WHEN artifact >= 0.4 OR cue <> 'none' THEN 'artifact check' END, CASE WHEN lc >= 0.4 THEN 'locally coherent' END,
    CASE WHEN es >= 0.35 THEN 'event-supported' END], lambda x: x IS NOT NULL), '; '), ''), 'discovery candidate') AS why FROM g""")
def suggestion_priority(spark: SparkSession, d: str) -> DataFrame:
    rows, c = _suggested(spark, d)
    why = F.array_join(scoring.suggestion_reasons(c, F.col("state"), F.col("cue")), "; ")
    return rows.select("id", F.round(scoring.suggestion_priority(c, F.col("state"), F.col("cue")), 6).alias("score"), why.alias("why"))


@query(f"""WITH {_SUGGESTED}, t AS (SELECT id, unnest([CASE WHEN state IN ('missed', 'promoted') THEN 'possible_missed_neuron' END, CASE WHEN state = 'artifact' OR cue <> 'none' OR artifact >= 0.4 THEN 'artifact_like' END]) AS category FROM g)
    SELECT id, category FROM t WHERE category IS NOT NULL""")
def suggestion_triage(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _suggested(spark, d)
    c = {"state": F.col("state"), "artifact_class": F.lit(""), "artifact_cue": F.col("cue"), "artifact_score": F.col("artifact_score")}
    return review.triage(rows, "id", review.suggestion_categories(c))


@query("""WITH g AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'accepted' WHEN 'F' THEN 'rejected' ELSE 'unsure' END AS state, CASE o_orderkey % 4 WHEN 0 THEN 'good' WHEN 1 THEN 'weak' WHEN 2 THEN 'noisy' ELSE '' END AS quality,
    CASE o_orderkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'maybe' ELSE 'no' END AS ready, CASE WHEN o_custkey % 5 = 0 THEN 'vessel' ELSE 'None' END AS class, CASE WHEN o_custkey % 9 = 0 THEN 'Merge it' ELSE '' END AS action,
    (o_custkey % 11) / 20.0::DOUBLE AS artifact, o_custkey % 13 = 0 AS grouped FROM orders),
    t AS (SELECT id, unnest([CASE WHEN state = 'accepted' AND quality = 'good' AND ready IN ('yes', 'maybe') AND class = 'None' AND artifact < 0.4 THEN 'strong_neuron' END, CASE WHEN class <> 'None' OR artifact >= 0.4 THEN 'artifact_like' END,
    CASE WHEN action = 'Merge it' OR grouped THEN 'merged_cluster' END, CASE WHEN quality IN ('weak', 'noisy', 'unusable') THEN 'weak_trace' END]) AS category FROM g) SELECT id, category FROM t WHERE category IS NOT NULL""")
def region_triage(spark: SparkSession, d: str) -> DataFrame:
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    c = {
        "cell_state": F.when(F.col("o_orderstatus") == "O", "accepted").when(F.col("o_orderstatus") == "F", "rejected").otherwise("unsure"),
        "trace_quality": F.when(key % 4 == 0, "good").when(key % 4 == 1, "weak").when(key % 4 == 2, "noisy").otherwise(""), "control_ready": F.when(key % 3 == 0, "yes").when(key % 3 == 1, "maybe").otherwise("no"),
        "artifact_class": F.when(owner % 5 == 0, "vessel").otherwise("None"), "needs_action": F.when(owner % 9 == 0, "Merge it").otherwise(""), "artifact_score": owner % 11 / 20.0,
    }
    return review.triage(table(spark, d, "orders"), "o_orderkey", review.region_categories(c, owner % 13 == 0)).withColumnRenamed("o_orderkey", "id")


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS o, l_partkey AS i FROM lineitem), n AS (SELECT o, count(*) AS n FROM s GROUP BY o),
    b AS (SELECT x.o AS a, y.o AS b, count(*) AS n_both FROM s x JOIN s y USING (i) WHERE x.o < y.o GROUP BY ALL)
    SELECT a, b, n_both, round(n_both / (na.n + nb.n - n_both), 9) AS iou FROM b JOIN n na ON na.o = a JOIN n nb ON nb.o = b""")
def object_overlap(spark: SparkSession, d: str) -> DataFrame:
    return candidates.shared_items(table(spark, d, "lineitem"), "l_suppkey", "l_partkey").withColumn("iou", F.round("iou", 9))


@query("""WITH RECURSIVE s AS (SELECT DISTINCT o_orderkey, o_orderstatus, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('O', 'F')),
    p AS (SELECT a.o_orderkey AS gt, b.o_orderkey AS cand, count(*) AS n_both FROM s a JOIN s b USING (l_partkey) WHERE a.o_orderstatus = 'O' AND b.o_orderstatus = 'F' GROUP BY ALL HAVING count(*) >= 2),
    q AS (SELECT *, row_number() OVER (ORDER BY n_both DESC, gt, cand) AS k FROM p),
    r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gs, []::BIGINT[] AS cs UNION ALL
          SELECT n.k, list_append(r.gs, n.gt), list_append(r.cs, n.cand) FROM r, LATERAL (SELECT k, gt, cand FROM q WHERE q.k > r.k AND NOT list_contains(r.gs, gt) AND NOT list_contains(r.cs, cand) ORDER BY q.k LIMIT 1) n),
    l AS (SELECT gs, cs FROM r ORDER BY k DESC LIMIT 1), m AS (SELECT unnest(gs) AS gt, unnest(cs) AS cand FROM l)
    SELECT p.gt, p.cand, n_both, -n_both AS far FROM p JOIN m USING (gt, cand)""")
def object_match_greedy(spark: SparkSession, d: str) -> DataFrame:
    """One-to-one matching of orders of two customers' segments by shared parts."""
    items, owners = table(spark, d, "lineitem").select("l_orderkey", "l_partkey"), table(spark, d, "orders").where("o_orderstatus in ('O', 'F')").select("o_orderkey", "o_orderstatus")
    parts = joins.tasks_for(spark, items.count())
    rows = items.repartition(parts, "l_orderkey").join(owners.repartition(parts, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    sets = _kept(rows.select("o_orderkey", "o_orderstatus", "l_partkey").distinct())
    side = lambda status, name: sets.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias(name), "l_partkey")
    shared = joins.shared_pairs(side("O", "gt"), side("F", "cand"), "l_partkey", "gt", "cand").where("n_both >= 2").withColumn("far", -F.col("n_both"))
    return joins.greedy_match(shared, "gt", "cand", ["far", "gt", "cand"])


@query("""WITH n AS (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem)
    SELECT l_partkey, count(DISTINCT l_returnflag) AS support, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS runs,
           (count(DISTINCT l_returnflag) = any_value(n.n))::INT AS in_all, (count(DISTINCT l_returnflag) = 1)::INT AS unique FROM lineitem, n GROUP BY l_partkey""")
def candidate_consensus(spark: SparkSession, d: str) -> DataFrame:
    return candidates.consensus(table(spark, d, "lineitem"), "l_returnflag", "l_partkey")


@query("""WITH s AS (SELECT DISTINCT l_returnflag AS r, l_partkey AS c FROM lineitem), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    b AS (SELECT x.r AS a, y.r AS b, count(*) AS nb FROM s x JOIN s y USING (c) WHERE x.r < y.r GROUP BY ALL)
    SELECT na.r AS run_a, nb.r AS run_b, coalesce(b.nb, 0) AS n_both, na.n + nb.n - coalesce(b.nb, 0) AS n_either, na.n - coalesce(b.nb, 0) AS only_a, nb.n - coalesce(b.nb, 0) AS only_b,
           coalesce(b.nb, 0) / (na.n + nb.n - coalesce(b.nb, 0)) AS jaccard FROM n na JOIN n nb ON na.r < nb.r LEFT JOIN b ON b.a = na.r AND b.b = nb.r""")
def run_overlap(spark: SparkSession, d: str) -> DataFrame:
    return candidates.run_overlap(table(spark, d, "lineitem"), "l_returnflag", "l_partkey")


@query("""WITH m AS (SELECT l_suppkey AS run, round(avg(l_quantity), 6) AS q, round(avg(l_discount), 6) AS dc, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1)
    SELECT 'quantity' AS metric, min_by(run, struct_pack(a := -q, b := run)) AS run, max(q) AS value FROM m
    UNION ALL SELECT 'discount', min_by(run, struct_pack(a := dc, b := run)), min(dc) FROM m UNION ALL SELECT 'rows', min_by(run, struct_pack(a := -n, b := run)), max(n) FROM m""")
def metric_winners(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run")).agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").cast("double").alias("rows"))
    tall = per.unpivot(["run"], ["quantity", "discount", "rows"], "metric", "value")
    return candidates.metric_winners(tall, {"quantity": "higher", "discount": "lower", "rows": "higher"})


# --- review ---


@query("""WITH r AS (SELECT quality AS a, 1 - toxic AS b FROM labels WHERE quality IN (0, 1) AND toxic IN (0, 1)),
    m AS (SELECT count(*) AS n, avg((a = b)::INT) AS observed, avg(a) AS pa, avg(b) AS pb FROM r),
    x AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS expected FROM m)
    SELECT n, round(observed, 9) AS observed, round(expected, 9) AS expected, round((observed - expected) / (1 - expected), 9) AS kappa FROM x""")
def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    out = review.cohen_kappa(table(spark, d, "labels").withColumn("clean", 1 - F.col("toxic")), "quality", "clean")
    return out.withColumns({c: F.round(c, 9) for c in ("observed", "expected", "kappa")})


_RATERS = """a AS (SELECT doc_id, lang AS g, (n_chars >= 500)::INT AS label FROM documents), b AS (SELECT doc_id, d.lang AS g, quality AS label FROM labels JOIN documents d USING (doc_id)),
    j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.g, b.g) AS g, a.label AS x, b.label AS y FROM a FULL JOIN b ON a.doc_id = b.doc_id)"""


def _raters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    first = docs.select("doc_id", F.col("lang").alias("g"), (F.col("n_chars") >= 500).cast("int").alias("label"))
    return first, table(spark, d, "labels").join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", F.col("lang").alias("g"), F.col("quality").alias("label"))


@query(f"""WITH {_RATERS} SELECT g AS subject_group, grouping(g)::INT AS overall, count(*) AS subjects, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS both_labelled, count(*) FILTER (x = y) AS equal,
    count(*) FILTER (x IS NULL) AS missing_first, count(*) FILTER (y IS NULL) AS missing_second, count(*) FILTER (x <> y) AS to_settle, count(*) FILTER (x = y) / count(*) AS exact_share
    FROM j GROUP BY GROUPING SETS ((), (g))""")
def agreement_report(spark: SparkSession, d: str) -> DataFrame:
    return review.agreement(*_raters(spark, d), "doc_id", "label", "g").withColumn("overall", F.col("overall").cast("int"))


@query(f"WITH {_RATERS} SELECT doc_id, x AS label_first, y AS label_second FROM j WHERE x IS DISTINCT FROM y")
def disagreement_queue(spark: SparkSession, d: str) -> DataFrame:
    return review.disagreements(*_raters(spark, d), "doc_id", "label")


@query(f"WITH {_RATERS} SELECT coalesce(x::VARCHAR, 'missing') AS first, coalesce(y::VARCHAR, 'missing') AS second, count(*) AS n FROM j GROUP BY ALL")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return annotations.label_pairs(*_raters(spark, d), "doc_id", "label")


@query("""SELECT l_suppkey AS run_id, round(avg(l_quantity), 6) AS object_quantity, round(max(l_tax), 6) AS runtime_tax FROM lineitem GROUP BY 1""")
def run_comparison(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("run_id")).agg(F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.max("l_tax"), 6).alias("tax"))
    tall = per.unpivot(["run_id"], ["quantity", "tax"], "metric", "value").withColumn("section", F.when(F.col("metric") == "tax", "runtime").otherwise("object"))
    return annotations.comparison(tall, [("object", "quantity"), ("runtime", "tax")])


@query("""SELECT 'roi:' || c_custkey AS task_id, 'roi' AS task_type, c_custkey::VARCHAR AS subject_id, c_acctbal AS priority FROM customer WHERE c_acctbal > 9000
    UNION ALL SELECT 'event:' || o_custkey || ':' || o_orderkey, 'event', o_custkey || ':' || o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 480000
    UNION ALL SELECT 'suggestion:' || s_suppkey, 'suggestion', s_suppkey::VARCHAR, s_acctbal FROM supplier WHERE s_acctbal > 5000""")
def review_tasks(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("region_id"), F.col("c_acctbal").alias("score"))
    found = table(spark, d, "orders").where("o_totalprice > 480000").select(F.col("o_custkey").alias("region_id"), F.col("o_orderkey").alias("frame"), F.col("o_totalprice").alias("score"))
    hints = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("suggestion_id"), F.col("s_acctbal").alias("score"))
    return annotations.review_tasks(regions, found, hints)


@query("""WITH {e}, p AS (SELECT event_type AS k, hour::DOUBLE AS a, micros / 3600000000 AS b FROM e)
    SELECT k, count(*) AS n_points, count(*) AS n_errors, round(max(abs(a - (b - 0.5))), 9) AS max_error, round(avg(abs(a - (b - 0.5))), 9) AS mean_error, 0.4::DOUBLE AS tolerance, CASE WHEN max(abs(a - (b - 0.5))) > 0.4 THEN 'failed' ELSE 'ok' END AS sync FROM p GROUP BY k""")
def sync_errors(spark: SparkSession, d: str) -> DataFrame:
    points = events(spark, d).select(F.col("event_type").alias("k"), F.col("hour").cast("double").alias("imaging_sec"), (F.col("micros") / 3_600_000_000).alias("behavior_sec"), F.lit(-0.5).alias("offset_sec"), F.lit(0.4).alias("tolerance_sec"))
    return annotations.sync_errors(points, "k").withColumns({"max_error": F.round("max_error", 9), "mean_error": F.round("mean_error", 9)})


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'P') AS n_p,
    round(avg((o_orderstatus IN ('O', 'F'))::INT), 9) AS reviewed_share FROM orders GROUP BY 1""")
def annotation_summary(spark: SparkSession, d: str) -> DataFrame:
    return review.state_summary(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F", "P"], ["O", "F"]).withColumn("reviewed_share", F.round("reviewed_share", 9))


@query("""SELECT o_orderstatus, o_orderpriority, (2 * grouping(o_orderstatus) + grouping(o_orderpriority))::INT AS level, count(*) AS n, count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS n_named,
    count(CASE WHEN o_totalprice > 250000 THEN 1 END) / count(*) AS coverage FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def provenance_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("reviewer", F.when(F.col("o_totalprice") > 250000, F.lit("r")))
    return review.provenance(rows, "o_orderstatus", "o_orderpriority", "reviewer")


@query("SELECT l_returnflag, l_linestatus, (2 * grouping(l_returnflag) + grouping(l_linestatus))::INT AS level, count(*) AS n, sum(l_quantity)::DOUBLE AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT c_custkey, category FROM (SELECT c_custkey, unnest([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_acctbal > 9000 THEN 'large' END,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END, CASE WHEN c_nationkey < 5 AND c_acctbal > 5000 THEN 'local_large' END]) AS category FROM customer) WHERE category IS NOT NULL""")
def triage_categories(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    return review.triage(table(spark, d, "customer"), "c_custkey", {"negative": b < 0, "large": b > 9000, "building": F.col("c_mktsegment") == "BUILDING", "local_large": (F.col("c_nationkey") < 5) & (b > 5000)})


@query("""WITH m AS (SELECT c_custkey, c_acctbal, unnest([CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machinery' END, CASE WHEN c_nationkey = 0 THEN 'first_nation' END]) AS queue FROM customer)
    SELECT c_custkey, c_acctbal, queue, row_number() OVER (PARTITION BY queue ORDER BY c_acctbal DESC, c_custkey) AS place, count(*) OVER (PARTITION BY queue) AS queue_length FROM m WHERE queue IS NOT NULL QUALIFY place <= 25""")
def guided_queues(spark: SparkSession, d: str) -> DataFrame:
    queues = {"rich": F.col("c_acctbal") > 5000, "machinery": F.col("c_mktsegment") == "MACHINERY", "first_nation": F.col("c_nationkey") == 0}
    return review.guided_queues(table(spark, d, "customer"), "c_custkey", "c_acctbal", queues, 25).withColumn("place", F.col("place").cast("long"))


@query("""WITH p AS (SELECT c_custkey, c_acctbal AS score FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20),
    c AS (SELECT o_orderkey, o_totalprice + CASE WHEN p.c_custkey IS NULL THEN 0 ELSE 100000 END AS score FROM orders LEFT JOIN p ON p.c_custkey = o_custkey ORDER BY 2 DESC, 1 LIMIT 40)
    SELECT 'parent' AS kind, c_custkey AS id, score FROM p UNION ALL SELECT 'child', o_orderkey, score FROM c""")
def next_batch(spark: SparkSession, d: str) -> DataFrame:
    children = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return review.next_batch(table(spark, d, "customer"), children, "c_custkey", "o_orderkey", "c_acctbal", "o_totalprice", 20, 40, 100000.0)


#: The features as a region's, with places for what parts lack.
_REGION = """f2 AS (SELECT *, local_correlation * 10 AS lc, event_support * 10 AS es, peak_z * 5 AS area, peak_z / 6 AS elongation FROM f)"""


_UNIT = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"


def _unit(x: str) -> str:
    return _UNIT.format(x)


_NAMES = {"event_count": "event_count", "trace_snr": "trace_snr", "local_correlation": "lc", "event_support": "es", "artifact_score": "artifact_score", "area": "area", "elongation": "elongation"}


def _region(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    rows = _features(spark, d).withColumns({"lc": F.col("local_correlation") * 10, "es": F.col("event_support") * 10, "area": F.col("peak_z") * 5, "elongation": F.col("peak_z") / 6})
    return rows, {k: F.col(v) for k, v in _NAMES.items()} | {"raw_score": F.col("raw_score")}


@query(f"""WITH {_FEATURES}, {_REGION} SELECT p_partkey, round(1e-9 + raw_score + 0.45 * least(event_count, 8) + 0.25 * least(greatest(trace_snr, 0), 6) + 1.2 * {_unit("lc")} + 1.1 * {_unit("es")} - 1.6 * {_unit("artifact_score")} + CASE WHEN peak_z > 25 THEN 0 ELSE 2.0 END + CASE WHEN event_count > 35 THEN 0.6 ELSE 0 END
    + CASE WHEN area BETWEEN 20 AND 180 THEN 0.35 ELSE 0 END, 6)::DOUBLE AS score,
    CASE WHEN NOT peak_z > 25 THEN CASE WHEN artifact_score >= 0.4 THEN 'artifact_check' WHEN trace_snr < 1.5 THEN 'weak_trace_check' WHEN event_count > 0 THEN 'event_supported_unlabeled' ELSE 'unlabeled_roi' END
    WHEN peak_z > 40 AND NOT event_count > 30 THEN 'control_readiness_check' ELSE 'reviewed_followup' END AS category,
    array_to_string(list_filter([CASE WHEN NOT peak_z > 25 THEN 'unlabeled ROI' END, CASE WHEN event_count > 0 THEN event_count || ' candidate events' END, CASE WHEN trace_snr >= 1.5 THEN 'usable trace SNR' WHEN trace_snr > 0 THEN 'weak trace SNR' END,
    CASE WHEN lc >= 0.4 THEN 'locally coherent' WHEN lc > 0 THEN 'low local coherence' END, CASE WHEN es >= 0.35 THEN 'event-supported footprint' END, CASE WHEN artifact_score >= 0.4 THEN 'artifact risk' END,
    CASE WHEN event_count > 35 THEN 'needs split' END], lambda x: x IS NOT NULL), '; ') AS why FROM f2""")
def region_priority(spark: SparkSession, d: str) -> DataFrame:
    rows, c = _region(spark, d)
    reviewed = F.col("peak_z") > 25
    score = scoring.region_priority(c, reviewed, F.col("event_count") > 35)
    category = scoring.region_category(c, reviewed, F.col("peak_z") > 40, F.col("event_count") > 30)
    why = scoring.region_reasons(c, reviewed, F.when(F.col("event_count") > 35, "split"))
    return rows.select("p_partkey", F.round(score + 1e-9, 6).alias("score"), category.alias("category"), F.array_join(why, "; ").alias("why"))


@query(f"""WITH {_FEATURES}, {_REGION} SELECT p_partkey, round(greatest(0, least(1, 0.45 * {_unit("artifact_score")} + CASE WHEN lc > 0 THEN 0.15 * {_unit("(0.40 - lc) / 0.40")} ELSE 0 END + 0.10 * {_unit("(area - 140) / 160")} + CASE WHEN area > 0 THEN 0.08 * {_unit("(8 - area) / 8")} ELSE 0 END
    + 0.10 * {_unit("(elongation - 3) / 4")} + CASE WHEN trace_snr > 0 THEN 0.08 * {_unit("(1.5 - trace_snr) / 1.5")} ELSE 0 END + CASE WHEN peak_z <= 2 THEN 0.08 ELSE 0 END + CASE WHEN event_count > 45 THEN 0.15 ELSE 0 END)), 6)::DOUBLE AS risk FROM f2""")
def artifact_risk(spark: SparkSession, d: str) -> DataFrame:
    rows, c = _region(spark, d)
    return rows.select("p_partkey", F.round(scoring.artifact_risk(c, F.col("peak_z") <= 2, F.col("event_count") > 45), 6).alias("risk"))


@query(f"""WITH {_FEATURES}, {_REGION} SELECT p_partkey, round(1e-9 + greatest(0, least(1, 0.35 * {_unit("es")} + 0.20 * {_unit("es")} + 0.18 * {_unit("es")} + 0.14 * {_unit("lc")} + 0.06 * {_unit("trace_snr / 6")} + 0.04 * {_unit("event_count / 20")} - 0.22 * {_unit("artifact_score")}
    - 0.08 * {_unit("(area - 180) / 180")} - 0.08 * {_unit("(elongation - 3) / 4")} + CASE WHEN peak_z <= 2 THEN -0.05 ELSE 0 END
    + CASE WHEN peak_z > 45 THEN -0.35 WHEN peak_z < 6 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS score FROM f2""")
def proposal_score(spark: SparkSession, d: str) -> DataFrame:
    rows, c = _region(spark, d)
    c |= {"priority": F.col("es"), "max_z": F.col("trace_snr"), "active_frames": F.col("event_count")}
    state = F.when(F.col("peak_z") > 45, "rejected").when(F.col("peak_z") < 6, "accepted").otherwise("")
    return rows.select("p_partkey", F.round(scoring.proposal_score(c, F.col("peak_z") <= 2, state) + 1e-9, 6).alias("score"))


@query(f"""WITH {_FEATURES}, {_REGION}, s AS (SELECT *, round({_SCORE}, 6) AS score FROM f2), m AS (SELECT median(score) AS mid FROM s)
    SELECT p_partkey, round(score + CASE WHEN abs(score - mid) <= greatest(0.25, 0.15 * abs(mid)) THEN 0.35 ELSE 0 END + CASE WHEN trace_snr > 0.5 AND trace_snr < 1.8 THEN 0.35 ELSE 0 END
    + CASE WHEN lc > 0.2 AND lc < 0.45 THEN 0.25 ELSE 0 END + CASE WHEN es > 0.2 AND es < 0.45 THEN 0.25 ELSE 0 END + CASE WHEN artifact_score > 0.3 AND artifact_score < 0.65 THEN 0.35 ELSE 0 END
    + CASE WHEN artifact_score >= 0.4 AND (event_count > 0 OR trace_snr >= 1.5 OR es >= 0.35) THEN 0.75 ELSE 0 END + CASE WHEN peak_z > 25 THEN 0 ELSE 0.75 END, 6)::DOUBLE AS active_score
    FROM s, m ORDER BY active_score DESC, p_partkey LIMIT 30""")
def active_batch(spark: SparkSession, d: str) -> DataFrame:
    """The thirty parts whose review teaches most."""
    rows, c = _region(spark, d)
    own = {name: F.col(name) for name in candidates.PRIORITY_TERMS}
    rows = rows.withColumn("score", X.rounded(candidates.priority(own, F.col("peak_z")), 6))
    middle = F.broadcast(rows.agg(F.median("score").alias("mid")))  # one row
    score = scoring.active_score(c, F.col("score"), F.col("mid"), F.col("peak_z") > 25)
    return rows.crossJoin(middle).select("p_partkey", X.rounded(score, 6).alias("active_score")).orderBy(F.desc("active_score"), "p_partkey").limit(30)


_TASKS = f"""{_FEATURES}, {_REGION}, s AS (SELECT *, round({_SCORE}, 6) AS score, CASE WHEN p_partkey % 5 = 0 THEN 'accepted' WHEN p_partkey % 7 = 0 THEN 'unlabeled' ELSE '' END AS state FROM f2), m AS (SELECT median(score) AS mid FROM s),
    u AS (SELECT *, abs(score - mid) <= greatest(0.25, 0.15 * abs(mid)) AS near, trace_snr > 0.5 AND trace_snr < 1.8 AS ts, lc > 0.2 AND lc < 0.45 AS cs, es > 0.2 AND es < 0.45 AS ev, artifact_score > 0.3 AND artifact_score < 0.65 AS ar,
          artifact_score >= 0.4 AND (event_count > 0 OR trace_snr >= 1.5 OR es >= 0.35) AS cf FROM s, m WHERE state <> 'accepted'),
    v AS (SELECT *, CASE WHEN near THEN 0.35 ELSE 0 END + CASE WHEN ts THEN 0.35 ELSE 0 END + CASE WHEN cs THEN 0.25 ELSE 0 END + CASE WHEN ev THEN 0.25 ELSE 0 END + CASE WHEN ar THEN 0.35 ELSE 0 END AS unsure FROM u),
    b AS (SELECT p_brand, count(*) AS many, max(score) AS top, min((state = 'accepted')::INT) AS done, p_brand LIKE '%1' AS issue FROM s JOIN part USING (p_partkey) WHERE p_size <= 3 GROUP BY 1),
    t AS (SELECT 'candidate:' || p_partkey AS task_id, 'candidate' AS task_type, p_partkey::VARCHAR AS subject_id, round(score + unsure + CASE WHEN cf THEN 0.75 ELSE 0 END + 0.75, 6)::DOUBLE AS active_score, score::DOUBLE AS priority_score,
          round(unsure, 6)::DOUBLE AS uncertainty_score, 'unlabeled' AS state,
          list_filter(['high_priority_unlabeled', CASE WHEN near OR ts OR cs OR ev OR ar THEN 'decision_boundary_uncertainty' END, CASE WHEN cf THEN 'artifact_neuron_conflict' END], lambda x: x IS NOT NULL) AS chosen,
          list_sort(list_filter(['unlabeled_candidate', CASE WHEN near THEN 'decision_boundary' END, CASE WHEN ts THEN 'trace_snr_uncertainty' END, CASE WHEN cs THEN 'local_coherence_uncertainty' END, CASE WHEN ev THEN 'event_support_uncertainty' END,
          CASE WHEN ar THEN 'artifact_uncertainty' END, CASE WHEN cf THEN 'artifact_neuron_conflict' END], lambda x: x IS NOT NULL)) AS codes FROM v
        UNION ALL SELECT 'cluster:' || p_brand, 'cluster', p_brand, round(top + 1.25 + 0.25 * many + CASE WHEN issue THEN 0.75 ELSE 0 END, 6)::DOUBLE, top::DOUBLE, 0.0, NULL, ['split_merge_cluster'],
          CASE WHEN issue THEN ['possible_duplicate', 'split_merge_cluster'] ELSE ['split_merge_cluster'] END FROM b WHERE done = 0)"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    """Parts as candidates, and brands as clusters of their smallest parts."""
    rows, _ = _region(spark, d)
    own = {name: F.col(name) for name in candidates.PRIORITY_TERMS}
    key = F.col("p_partkey")
    found = rows.select(
        key.alias("candidate_id"), X.rounded(candidates.priority(own, F.col("peak_z")), 6).alias("priority_score"), F.when(key % 5 == 0, "Accepted").when(key % 7 == 0, "unlabeled").otherwise("").alias("state"),
        "trace_snr", F.col("lc").alias("local_correlation"), F.col("es").alias("event_support"), "artifact_score", "event_count",
    )
    brands = table(spark, d, "part").where("p_size <= 3").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.collect_list("p_partkey").alias("candidate_ids"))
    issue = F.when(F.col("cluster_id").endswith("1"), F.array(F.lit("possible_duplicate"))).otherwise(F.array().cast("array<string>"))
    return active.candidate_tasks(found).unionByName(active.cluster_tasks(brands.withColumn("issue_codes", issue), found))


@query(f"WITH {_TASKS} SELECT task_id, task_type, subject_id, active_score, priority_score, uncertainty_score, state, array_to_string(chosen, ',') AS selected_by, array_to_string(codes, ',') AS reason_codes FROM t")
def active_tasks(spark: SparkSession, d: str) -> DataFrame:
    return _tasks(spark, d).withColumns({"selected_by": F.array_join("selected_by", ","), "reason_codes": F.array_join("reason_codes", ",")})


@query(f"""WITH {_TASKS}, k AS (SELECT * FROM t ORDER BY active_score DESC, task_id LIMIT 200)
    SELECT 'type' AS kind, task_type AS name, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT 'strategy', name, count(*) FROM (SELECT unnest(chosen) AS name FROM k) GROUP BY ALL""")
def active_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    return active.batch_counts(active.review_batch(_tasks(spark, d), 200))


@query(f"""WITH {_FEATURES}, {_REGION}, {_SUGGESTED}, r AS (SELECT 'roi' AS subject_type, p_partkey::VARCHAR AS subject_id, CASE WHEN p_partkey % 3 = 0 THEN 'accepted' ELSE 'unlabeled' END AS label_state, round(raw_score, 4) AS priority_score,
        event_count::DOUBLE AS event_count, area, round(trace_snr, 9) AS trace_snr, round(lc, 9) AS local_correlation, es AS event_support, round(artifact_score, 9) AS artifact_score,
        list_filter([CASE WHEN artifact_score >= 0.4 THEN 'artifact_check' END, CASE WHEN event_count > 30 THEN 'event_support' END, CASE WHEN trace_snr > 2.6 THEN 'trace_snr' END, CASE WHEN p_partkey % 3 <> 0 THEN 'unlabeled_roi' END], lambda x: x IS NOT NULL) AS codes FROM f2),
    c AS (SELECT 'suggestion', id::VARCHAR, CASE WHEN state = '' THEN 'unlabeled' ELSE state END, round(priority * 10, 4), NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, round(lc, 9), round(es, 9), round(artifact, 9),
        list_filter([CASE WHEN artifact >= 0.4 OR cue <> 'none' THEN 'artifact_check' END, CASE WHEN es >= 0.35 THEN 'event_support' END, CASE WHEN lc >= 0.4 THEN 'local_coherence' END, CASE WHEN state = '' THEN 'unlabeled_suggestion' END], lambda x: x IS NOT NULL) FROM g)
    SELECT * EXCLUDE (codes), array_to_string(codes, ',') AS reason_codes FROM (SELECT * FROM r UNION ALL SELECT * FROM c)""")
def review_features(spark: SparkSession, d: str) -> DataFrame:
    """Parts as regions and customers as suggestions, for learning from reviews."""
    rows, _ = _region(spark, d)
    reviewed = F.col("p_partkey") % 3 == 0
    texts = X.reasons((~reviewed, "unlabeled ROI"), (F.col("artifact_score") >= 0.4, "artifact risk"), (F.col("event_count") > 30, "many events"), (F.col("trace_snr") > 2.6, "high trace SNR"), (reviewed, "seen"))
    region = rows.select(F.col("p_partkey").alias("id"), F.when(reviewed, "accepted").otherwise("").alias("state"), F.col("raw_score").alias("priority_score"), "event_count", "area", "trace_snr", F.col("lc").alias("local_correlation"), F.col("es").alias("event_support"), "artifact_score", texts.alias("reasons"))
    found, c = _suggested(spark, d)
    suggestion = found.select("id", "state", (F.col("priority") * 10).alias("priority_score"), "local_correlation", "event_support", "artifact_score", scoring.suggestion_reasons(c, F.col("state"), F.col("cue")).alias("reasons"))
    out = active.feature_rows({"roi": region, "suggestion": suggestion})
    return out.withColumns({x: F.round(x, 9) for x in ("trace_snr", "local_correlation", "event_support", "artifact_score")})


# --- ground truth over time, cut-offs ---

_PLACES = "g AS (SELECT user_id AS gt_id, hour AS frame, value AS x, k::DOUBLE AS y FROM e WHERE event_type IN ('view', 'click'))"


def _places(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("event_type in ('view', 'click')").select(F.col("user_id").alias("gt_id"), F.col("hour").alias("frame"), F.col("value").alias("x"), F.col("k").cast("double").alias("y"))


_DRIFT = """w AS (SELECT *, row_number() OVER (PARTITION BY gt_id ORDER BY frame, x, y) AS a, row_number() OVER (PARTITION BY gt_id ORDER BY frame DESC, x, y) AS b FROM g),
    r AS (SELECT f.gt_id, f.frame AS first, l.frame AS last, l.frame - f.frame + 1 AS duration, sqrt((l.x - f.x) ** 2 + (l.y - f.y) ** 2) AS distance FROM w f JOIN w l USING (gt_id) WHERE f.a = 1 AND l.b = 1)"""


@query(f"WITH {{e}}, {_PLACES}, {_DRIFT} SELECT gt_id, first, last, duration, round(distance, 6) AS distance FROM r")
def event_drift(spark: SparkSession, d: str) -> DataFrame:
    return detection.drift(_places(spark, d)).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {{e}}, {_PLACES}, {_DRIFT} SELECT (SELECT count(*) FROM g) AS points, count(*) AS identifiers, round(100 * (SELECT count(*) FROM g) / 720000.0::DOUBLE, 9) AS occupancy, round(max(distance), 6) AS max_drift, round(max(distance) / 2, 6) AS max_drift_um FROM r""")
def truth_summary(spark: SparkSession, d: str) -> DataFrame:
    out = detection.ground_truth_summary(_places(spark, d), 720_000)
    return out.withColumns({"occupancy": F.round("occupancy", 9), "max_drift": F.round("max_drift", 6), "max_drift_um": F.round("max_drift_um", 6)})


_FOUND = f"""{{e}}, {_GT.replace("event_id AS gt_id", "user_id AS gt_id")}, {_DET}, q AS (SELECT DISTINCT frame, gt_id, x, y FROM gt),
    n AS (SELECT q.*, EXISTS (SELECT 1 FROM det WHERE det.frame = q.frame AND z >= 25 AND sqrt((q.x - det.x) ** 2 + (q.y - det.y) ** 2) <= 5) AS hit FROM q),
    o AS (SELECT gt_id, count(*) AS points, count(*) FILTER (hit) AS found FROM n GROUP BY 1)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    truth = events(spark, d).where("event_type = 'purchase'").select(F.col("hour").alias("frame"), F.col("user_id").alias("gt_id"), F.col("value").alias("x"), _second())
    return detection.found_by_id(truth, _detections(spark, d), 5.0, 25.0)


@query(f"WITH {_FOUND} SELECT gt_id, points, found, points - found AS missed FROM o")
def found_by_object(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)


@query(f"WITH {_FOUND} SELECT count(*) AS identifiers, count(*) FILTER (found > 0) AS detected, count(*) FILTER (found > 0) / count(*) AS rate FROM o")
def unique_detection(spark: SparkSession, d: str) -> DataFrame:
    return detection.unique_rate(_found(spark, d))


@query(f"WITH {_SWEEP}, b AS (SELECT * FROM sweep QUALIFY row_number() OVER (PARTITION BY tp ORDER BY fppi, event_type, threshold DESC) = 1) SELECT * FROM b ORDER BY tp DESC LIMIT 5")
def best_levels(spark: SparkSession, d: str) -> DataFrame:
    return detection.best_by_level(_sweep(spark, d), ["event_type"], 5)


@query("""SELECT l_returnflag, c AS cutoff, count(*) FILTER (l_discount >= c) AS kept, coalesce(sum(l_quantity) FILTER (l_discount >= c), 0) AS kept_size, count(*) FILTER (l_discount >= c) / 30.0::DOUBLE AS kept_by_frame,
    coalesce(sum(l_quantity) FILTER (l_discount >= c), 0) / 30.0::DOUBLE AS size_by_frame FROM lineitem, (SELECT unnest([0.02, 0.05, 0.08, 0.5])::DOUBLE AS c) GROUP BY ALL""")
def score_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return detection.cutoff_sweep(table(spark, d, "lineitem"), "l_discount", "l_quantity", [0.02, 0.05, 0.08, 0.5], 30, ["l_returnflag"])


# --- diagnostics ---


@query("""WITH {e}, s AS (SELECT user_id, micros - lag(micros) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM e),
    m AS (SELECT user_id, median(step) FILTER (step > 0) AS median_step, max(step) AS largest_step, count(*) FILTER (step = 0) AS n_repeated, count(*) FILTER (step < 0) AS n_falling FROM s GROUP BY 1),
    g AS (SELECT user_id, count(*) FILTER (step > 1.5 * median_step) AS n_gaps FROM s JOIN m USING (user_id) GROUP BY 1), c AS (SELECT user_id, count(*) AS n FROM e GROUP BY 1)
    SELECT user_id, n, 0::BIGINT AS n_missing, median_step, largest_step, n_repeated, n_falling, n_gaps FROM c JOIN m USING (user_id) JOIN g USING (user_id)""")
def timestamp_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.timestamp_diagnostics(events(spark, d), ["user_id"], "event_id", "micros")


@query("""WITH {e}, r AS (SELECT event_type, abs(hour / 1.0::DOUBLE - micros / 3600000000) AS error FROM e)
    SELECT event_type, round(max(error), 9) AS max_error, round(avg(error), 9) AS mean_error, CASE WHEN max(error) <= 0.75 THEN 'ok' ELSE 'failed' END AS status FROM r GROUP BY 1""")
def frame_time_mapping(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("hours", F.col("micros") / 3_600_000_000)
    out = diagnostics.mapping_error(rows, ["event_type"], "hour", "hours", 1.0, 0.75)
    return out.withColumns({"max_error": F.round("max_error", 9), "mean_error": F.round("mean_error", 9)})


@query("""WITH l AS (SELECT l_extendedprice AS v, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS f FROM lineitem),
    b AS (SELECT min(v) AS low, max(v) AS high, (min(f) + max(f) + 1) / 2 AS half FROM l)
    SELECT count(*) AS n, min(v) AS min_value, max(v) AS max_value, round(avg(v), 4) AS mean_value, round(stddev_pop(v), 4) AS std_value, round(quantile_cont(v, 0.01), 4) AS p01, round(quantile_cont(v, 0.5), 4) AS p50,
           round(quantile_cont(v, 0.99), 4) AS p99, count(*) FILTER (v = low) AS n_low, count(*) FILTER (v = high) AS n_high, round(avg(v) FILTER (f >= half) - avg(v) FILTER (f < half), 4) AS drift,
           count(*) FILTER (v = high) / count(*) AS saturated_share FROM l, b""")
def intensity_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).alias("f"), "l_extendedprice")
    out = diagnostics.intensity_quality(rows, "f", "l_extendedprice")
    return out.withColumns({c: F.round(c, 4) for c in ("mean_value", "std_value", "p01", "p50", "p99", "drift")})


@query("""WITH s AS (SELECT o_orderpriority AS g, o_totalprice AS v, list_sort(list(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS x FROM orders), n AS (SELECT o_orderpriority AS g, count(*) AS n, list_sort(list(o_totalprice)) AS x, max(o_totalprice) AS max_value,
    avg(o_totalprice) AS mean_value, median(o_totalprice) AS p50, count(*) FILTER (o_totalprice > 400000) AS n_over FROM orders GROUP BY 1)
    SELECT g AS o_orderpriority, n, max_value, round(mean_value, 4) AS mean_value, round(p50, 4) AS p50, n_over, x[1 + round_even((n - 1) * 0.95, 0)::INT] AS p95, x[1 + round_even((n - 1) * 0.99, 0)::INT] AS p99,
           (x[1 + round_even((n - 1) * 0.99, 0)::INT] <= 400000)::INT AS meets_budget FROM n""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    out = diagnostics.latency_percentiles(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", 400000)
    return out.withColumns({"mean_value": F.round("mean_value", 4), "p50": F.round("p50", 4)})


# --- signals ---


def _hourly(spark: SparkSession, d: str) -> DataFrame:
    """Dense counts by type and hour."""
    rows = activity.in_range(events(spark, d), HOURS, "hour")
    counts = rows.groupBy("event_type", "hour").agg(F.count("*").cast("double").alias("v"))
    grid = rows.select("event_type").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))))
    return grid.join(counts, ["event_type", "hour"], "left").fillna(0.0, ["v"])


_HOURLY = """{e}, h AS (SELECT t.event_type, r.b::INT AS hour, coalesce(c.v, 0)::DOUBLE AS v FROM (SELECT DISTINCT event_type FROM e) t CROSS JOIN range(720) r(b)
    LEFT JOIN (SELECT event_type, hour, count(*) AS v FROM e GROUP BY ALL) c ON c.event_type = t.event_type AND c.hour = r.b)"""


@query("""WITH {e}, m AS (SELECT day, median(value) AS m FROM e GROUP BY 1), s AS (SELECT day, median(abs(value - m)) AS s FROM e JOIN m USING (day) GROUP BY 1)
    SELECT event_id, day, round(greatest(0, (value - m) / (1.4826 * s + 1e-6)), 6) AS z FROM e JOIN m USING (day) JOIN s USING (day)""")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    return signal.robust_z(events(spark, d), "day", "value").select("event_id", "day", F.round("z", 6).alias("z"))


@query(f"""WITH {_HOURLY}, w AS (SELECT k, exp(-0.5 * pow(k / 2.0, 2)) AS w FROM range(-8, 9) t(k)), n AS (SELECT k, w / sum(w) OVER () AS w FROM w)
    SELECT a.event_type, a.hour, a.v, round(sum(n.w * b.v), 6) AS low, round(a.v - sum(n.w * b.v), 6) AS high FROM h a, n JOIN h b ON TRUE
    WHERE b.event_type = a.event_type AND b.hour = greatest(0, least(719, a.hour + n.k)) GROUP BY a.event_type, a.hour, a.v""")
def temporal_highpass(spark: SparkSession, d: str) -> DataFrame:
    return signal.highpass(_hourly(spark, d), ["event_type"], "hour", "v", 2.0, 0, HOURS - 1).withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("""WITH {e}, c AS (SELECT DISTINCT day AS y, (hour % 24)::INT AS x FROM e WHERE event_type = 'error' AND value > 60)
    SELECT a.y, a.x, count(*) AS support FROM c a JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL HAVING count(*) >= 3""")
def neighbour_support(spark: SparkSession, d: str) -> DataFrame:
    cells = events(spark, d).where("event_type = 'error' and value > 60").select(F.col("day").alias("y"), (F.col("hour") % 24).alias("x"))
    return signal.supported(cells, "x", "y", 3).select("y", "x", "support")


@query(f"""WITH {_HOURLY}, m AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)) SELECT event_type, hour, v FROM m WHERE b IS NOT NULL AND a IS NOT NULL AND v >= 4 AND v >= b AND v >= a""")
def local_maxima(spark: SparkSession, d: str) -> DataFrame:
    return signal.local_maxima(_hourly(spark, d), ["event_type"], "hour", "v", 4.0)


@query(f"""WITH RECURSIVE {_HOURLY}, m AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
    p AS (SELECT event_type, hour FROM m WHERE b IS NOT NULL AND a IS NOT NULL AND v >= 4 AND v >= b AND v >= a),
    n AS (SELECT x.event_type, x.hour, min(y.hour) AS next FROM p x JOIN p y ON y.event_type = x.event_type AND y.hour >= x.hour + 3 GROUP BY ALL),
    r AS (SELECT event_type, min(hour) AS hour FROM p GROUP BY 1 UNION ALL SELECT n.event_type, n.next FROM r JOIN n ON n.event_type = r.event_type AND n.hour = r.hour) SELECT event_type, hour FROM r""")
def peaks_apart(spark: SparkSession, d: str) -> DataFrame:
    return scans.spaced_peaks(signal.local_maxima(_hourly(spark, d), ["event_type"], "hour", "v", 4.0), ["event_type"], "hour", 3)


@query("""WITH RECURSIVE {e}, s AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY micros, event_id) AS k FROM e),
    r AS (SELECT user_id, event_id, k, value AS level, 0.0::DOUBLE AS z FROM s WHERE k = 1 UNION ALL
          SELECT s.user_id, s.event_id, s.k, level + CASE WHEN s.value < level THEN 0.11 WHEN s.value - level > 25 THEN 0.015 ELSE 0.08 END::DOUBLE * (s.value - level), greatest(0, s.value - level) / 10
          FROM r JOIN s ON s.user_id = r.user_id AND s.k = r.k + 1) SELECT user_id, event_id, round(z, 6) AS z FROM r""")
def innovation_scan(spark: SparkSession, d: str) -> DataFrame:
    """Every user's values as a series of any length, folded with a state that is carried on."""
    rows = events(spark, d).select("user_id", F.struct("micros", "event_id").alias("at"), "event_id", "value")
    return scans.scanned(rows, ["user_id"], "at", "value", scans.kalman_fold(noise=10.0)).select("user_id", "event_id", F.round("z", 6).alias("z"))


@query(f"""WITH {_HOURLY}, w AS (SELECT *, list(v) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS vs,
    coalesce(median(v) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), v) AS pre,
    coalesce(max(v) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), v) AS post FROM h)
    SELECT event_type, hour, v, pre, post, v - pre AS rise, round((v - pre) / greatest(1.0::DOUBLE, coalesce(1.4826 * list_median(list_transform(vs, lambda x: abs(x - pre))), 1.0)), 6) AS rise_z FROM w""")
def pre_post_rise(spark: SparkSession, d: str) -> DataFrame:
    return signal.rise(_hourly(spark, d), ["event_type"], "hour", "v").withColumn("rise_z", F.round("rise_z", 6))


@query(f"""WITH RECURSIVE {_HOURLY}, r AS (SELECT event_type, 0 AS hour, v AS m, 0.95::DOUBLE AS s, 0.0::DOUBLE AS z FROM h WHERE hour = 0
    UNION ALL SELECT h.event_type, h.hour, r.m + 0.05 * (h.v - r.m), 0.95 * r.s + 0.05 * (h.v - r.m) * (h.v - r.m), (h.v - r.m) / sqrt(r.s + 1e-6) FROM r JOIN h ON h.event_type = r.event_type AND h.hour = r.hour + 1)
    SELECT event_type, hour, round(z, 6) AS z FROM r""")
def ewma_z(spark: SparkSession, d: str) -> DataFrame:
    series = _hourly(spark, d).groupBy("event_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("hour", "v"))), lambda x: x["v"]).alias("values"))  # HOURS values for a type
    return series.select("event_type", F.posexplode(signal.ewma_z(F.col("values"), 0.05)).alias("hour", "z")).withColumn("z", F.round("z", 6))


@query("""WITH RECURSIVE r AS (SELECT vec_id, 1 AS k, embedding[1]::DOUBLE AS level, 0.0::DOUBLE AS z FROM embeddings UNION ALL
    SELECT r.vec_id, k + 1, level + CASE WHEN embedding[k + 1]::DOUBLE < level THEN 0.11 WHEN embedding[k + 1]::DOUBLE - level > 0.25 THEN 0.015 ELSE 0.08 END::DOUBLE * (embedding[k + 1]::DOUBLE - level),
    greatest(0, embedding[k + 1]::DOUBLE - level) / 0.1::DOUBLE FROM r JOIN embeddings e ON e.vec_id = r.vec_id WHERE k < 64),
    m AS (SELECT *, lag(z) OVER w AS b, lead(z) OVER w AS a FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY k))
    SELECT vec_id, (k - 1)::INT AS at, round(z, 6) AS z FROM m WHERE b IS NOT NULL AND a IS NOT NULL AND z >= 1 AND z >= b AND z >= a""")
def kalman_events(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as traces: places of positive innovations that peak."""
    found = table(spark, d, "embeddings").select("vec_id", F.posexplode(signal.kalman_innovation(F.col("embedding"), noise=0.1)).alias("at", "z"))
    return signal.local_maxima(found, ["vec_id"], "at", "z", 1.0).select("vec_id", "at", F.round("z", 6).alias("z"))


@query("""WITH {e}, x AS (SELECT DISTINCT user_id, day FROM e), g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM x)
    SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS length FROM g GROUP BY user_id, g""")
def activity_islands(spark: SparkSession, d: str) -> DataFrame:
    return signal.islands(events(spark, d), ["user_id"], "day")


# --- exports, functions, sets ---


@query("""SELECT conv_id, turn, role, translate(coalesce(text, ''), chr(9) || chr(10) || chr(13), '   ') AS text FROM conversations WHERE role IN ('user', 'assistant')""")
def export_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return rows.select("conv_id", "turn", "role", X.plain_text(F.col("text")).alias("text"))


@query("SELECT vec_id, (k - 1)::INT AS frame, (k - 1) / 5.0::DOUBLE AS time_sec, embedding[k]::DOUBLE AS value FROM embeddings, range(1, 65) t(k)")
def trace_export(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("frame", "value"))
    return rows.select("vec_id", "frame", (F.col("frame") / 5.0).alias("time_sec"), F.col("value").cast("double").alias("value"))


_READY = "vec_id % 3 = 0 AND vec_id % 4 < 2 AND vec_id % 7 <> 0 AND vec_id % 11 <> 0"


def _control(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Vectors as regions with traces, events as theirs; what annotations say follows from identifiers."""
    from ..sources.exports import control_tables

    key = F.col("vec_id")
    regions = table(spark, d, "embeddings").select(key.alias("roi_id"), F.col("embedding").cast("array<double>").alias("dff"), F.slice("embedding", 1, 40).cast("array<double>").alias("event_trace"), F.slice("embedding", 2, 50).cast("array<double>").alias("z"))
    marks = table(spark, d, "embeddings").select(
        key.alias("roi_id"), F.when(key % 3 == 0, "accepted").when(key % 3 == 1, "rejected").alias("cell_state"), F.when(key % 4 == 0, "good").when(key % 4 == 1, "weak").otherwise("noisy").alias("trace_quality"),
        F.when(key % 7 == 0, "no").otherwise("maybe").alias("control_ready"), F.when(key % 11 == 0, "vessel").alias("artifact_class"), F.col("label").cast("string").alias("identity_group"),
        F.lit("high").alias("confidence"), F.array(F.lit("seen"), F.lit("twice")).alias("reason_tags"),
    )
    rows = events(spark, d).select(F.col("user_id").alias("roi_id"), (F.col("hour") + 1).alias("frame"), "event_type", F.col("k").alias("z"), F.col("event_id").alias("amplitude"))
    told = rows.where("event_type = 'error'").groupBy("roi_id", "frame").agg(F.lit("accepted").alias("event_state"), F.lit("late").alias("timing_quality"))
    return control_tables(regions, rows.drop("event_type"), marks, told, 5.0)


@query(f"""SELECT vec_id::VARCHAR AS roi_id, k::VARCHAR AS frame, ((k - 1) / 5.0::DOUBLE)::VARCHAR AS time_sec, round(embedding[k]::DOUBLE, 6) AS dff, round(CASE WHEN k <= 40 THEN embedding[k]::DOUBLE END, 6) AS event_trace, round(CASE WHEN k <= 50 THEN embedding[k + 1]::DOUBLE END, 6) AS z,
    'accepted' AS cell_state, CASE WHEN vec_id % 4 = 0 THEN 'good' ELSE 'weak' END AS trace_quality, 'maybe' AS control_ready FROM embeddings, range(1, 65) t(k) WHERE {_READY}""")
def control_traces(spark: SparkSession, d: str) -> DataFrame:
    return _control(spark, d)["accepted_traces"].withColumns({c: F.round(F.col(c).try_cast("double"), 6) for c in ("dff", "event_trace", "z")})


@query(f"""WITH {{e}}, t AS (SELECT DISTINCT user_id, hour FROM e WHERE event_type = 'error')
    SELECT e.user_id::VARCHAR AS roi_id, (e.hour + 1)::VARCHAR AS frame, e.hour / 5.0::DOUBLE AS time_sec, e.k::VARCHAR AS z, e.event_id::VARCHAR AS amplitude, CASE WHEN t.user_id IS NULL THEN '' ELSE 'accepted' END AS event_state, '' AS event_type,
    CASE WHEN t.user_id IS NULL THEN '' ELSE 'late' END AS timing_quality, 'accepted' AS cell_state, 'maybe' AS control_ready FROM e JOIN embeddings ON vec_id = e.user_id LEFT JOIN t ON t.user_id = e.user_id AND t.hour = e.hour WHERE {_READY}""")
def control_events(spark: SparkSession, d: str) -> DataFrame:
    return _control(spark, d)["accepted_events"].withColumn("time_sec", F.col("time_sec").cast("double"))


@query(f"""SELECT vec_id::VARCHAR AS roi_id, 'accepted' AS cell_state, CASE WHEN vec_id % 4 = 0 THEN 'good' ELSE 'weak' END AS trace_quality, 'maybe' AS control_ready, '' AS artifact_class, label::VARCHAR AS identity_group, 'high' AS confidence, 'seen,twice' AS reason_tags
    FROM embeddings WHERE {_READY}""")
def control_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _control(spark, d)["neuron_metadata"]


@query("""WITH {e} SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, min(k) AS least, max(k) AS most FROM e GROUP BY 1""")
def props_json(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("""SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS hash FROM orders""")
def parameter_hash(spark: SparkSession, d: str) -> DataFrame:
    fields = F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.to_json(fields), 256).alias("hash"))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS n FROM customer), s AS (SELECT DISTINCT s_nationkey AS n FROM supplier)
    SELECT 'union' AS operation, count(*) AS n FROM (SELECT n FROM c UNION SELECT n FROM s) UNION ALL SELECT 'both', count(*) FROM (SELECT n FROM c INTERSECT SELECT n FROM s)
    UNION ALL SELECT 'customers_only', count(*) FROM (SELECT n FROM c EXCEPT SELECT n FROM s)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    c, s = table(spark, d, "customer").select(F.col("c_nationkey").alias("n")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"))
    each = {"union": c.union(s).distinct(), "both": c.intersect(s), "customers_only": c.exceptAll(c.join(s, "n", "left_semi")).distinct()}
    out = None
    for name, rows in each.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("operation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT r_regionkey, sigma, threshold, 'run_' || lpad((row_number() OVER (ORDER BY r_regionkey, sigma, threshold))::VARCHAR, 3, '0') AS run_id FROM region, (SELECT unnest([4.0, 6.0, 8.0])::DOUBLE AS sigma), (SELECT unnest([1.5, 2.0])::DOUBLE AS threshold)""")
def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    from .pipeline import sweep_frame

    grid = sweep_frame(spark, {"sigma": [4.0, 6.0, 8.0], "threshold": [1.5, 2.0]}).drop("run_id")
    rows = table(spark, d, "region").select("r_regionkey").crossJoin(F.broadcast(grid))  # six rows
    place = F.row_number().over(Window.orderBy("r_regionkey", "sigma", "threshold"))
    return rows.withColumn("run_id", F.concat(F.lit("run_"), F.lpad(place.cast("string"), 3, "0")))


@query("""WITH p AS (SELECT c_custkey, c_acctbal AS x, c_nationkey::DOUBLE AS y FROM customer), t AS (SELECT s_suppkey, s_acctbal AS tx, s_nationkey::DOUBLE AS ty FROM supplier),
    d AS (SELECT c_custkey, x, y, s_suppkey, sqrt(pow(x - tx, 2) + pow(y - ty, 2)) AS distance FROM p JOIN t ON abs(x - tx) <= 50 AND abs(y - ty) <= 50)
    SELECT c_custkey, x, y, min_by(s_suppkey, struct_pack(a := distance, b := s_suppkey)) AS nearest_s_suppkey, round(min(distance), 6) AS distance FROM d WHERE distance <= 50 GROUP BY ALL""")
def nearest_object(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    targets = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("tx"), F.col("s_nationkey").cast("double").alias("ty"))
    return joins.nearest(points, targets, ("x", "y"), ("tx", "ty"), "s_suppkey", 50.0).withColumn("distance", F.round("distance", 6))


@query("""WITH r AS (SELECT DISTINCT p_size AS x, (p_retailprice * 10)::INT % 40 AS y, p_brand AS region FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')),
    s AS (SELECT dy, dx FROM range(-3, 4) a(dy), range(-3, 4) b(dx) WHERE dy * dy + dx * dx BETWEEN 2 AND 9), n AS (SELECT dy, dx FROM range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE dy * dy + dx * dx <= 1),
    g AS (SELECT DISTINCT region, (y + dy)::INT AS y, (x + dx)::INT AS x FROM r, s)
    SELECT region, y, x FROM g WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.y = g.y AND r.x = g.x) AND NOT EXISTS (SELECT 1 FROM r, n WHERE r.region = g.region AND r.y + dy = g.y AND r.x + dx = g.x)""")
def ring_pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").where(F.col("p_brand").isin("Brand#1", "Brand#2"))
    regions = rows.select(F.col("p_brand").alias("region"), (F.round(F.col("p_retailprice") * 10).cast("int") % 40).alias("y"), F.col("p_size").alias("x")).distinct()
    return signal.ring_pixels(regions, 1, 3)


# --- images: a day of errors as a picture of hour by value ---


def _pictures(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.readers import long_frames

    rows = events(spark, d).where("day between 0 and 29")
    cells = rows.groupBy(F.col("day").alias("frame"), (F.col("hour") % 24).alias("y"), F.least(F.lit(23), F.floor(F.col("value") / 10)).cast("int").alias("x")).agg(F.count("*").cast("double").alias("v"))
    return long_frames(cells, 24, 24)


_CELLS = "c AS (SELECT day AS frame, (hour % 24)::INT AS y, least(23, floor(value / 10))::INT AS x, count(*)::DOUBLE AS v FROM e WHERE day BETWEEN 0 AND 29 GROUP BY ALL)"


@query(f"""WITH {{e}}, {_CELLS}, g AS (SELECT f.r::INT AS frame, y.r::INT AS y, x.r::INT AS x FROM range(30) f(r), range(24) y(r), range(24) x(r))
    SELECT y, x, round(avg(coalesce(v, 0)), 9) AS mean, round(stddev_pop(coalesce(v, 0)), 9) AS std, max(coalesce(v, 0)) AS peak, count(*) FILTER (v >= 2) AS n_active FROM g LEFT JOIN c USING (frame, y, x) GROUP BY ALL""")
def frame_projections(spark: SparkSession, d: str) -> DataFrame:
    out = signal.projections(signal.pixels(_pictures(spark, d)))
    return out.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query(f"""WITH RECURSIVE {{e}}, {_CELLS}, m AS (SELECT frame, y, x, y * 24 + x AS id FROM c WHERE v >= 2),
    l AS (SELECT a.frame, a.id AS a, b.id AS b FROM m a JOIN m b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    r AS (SELECT frame, id, id AS root FROM m UNION SELECT l.frame, l.b, r.root FROM r JOIN l ON l.frame = r.frame AND l.a = r.id),
    p AS (SELECT frame, id, min(root) AS part FROM r GROUP BY ALL)
    SELECT p.frame, part AS first_pixel, round(avg(x), 9) AS cx, round(avg(y), 9) AS cy, count(*) AS area FROM p JOIN m ON m.frame = p.frame AND m.id = p.id GROUP BY ALL HAVING count(*) >= 2""")
def frame_components(spark: SparkSession, d: str) -> DataFrame:
    rows = signal.by_frame(_pictures(spark, d), _components_of, "frame int, first_pixel int, cx double, cy double, area long")
    return rows.withColumns({"cx": F.round("cx", 9), "cy": F.round("cy", 9)})


def _components_of(frame: int, image):
    import numpy as np
    import pandas as pd

    parts = signal.labelled(image >= 2)
    rows = []
    for k in range(1, int(parts.max(initial=0)) + 1):
        y, x = np.nonzero(parts == k)
        if len(y) >= 2:
            rows.append((frame, int((y * image.shape[1] + x).min()), x.mean(), y.mean(), len(y)))
    return pd.DataFrame(rows, columns=["frame", "first_pixel", "cx", "cy", "area"])


_GROWN = f"""{{e}}, {_CELLS}, m AS (SELECT frame, y, x, v, y * 1048576 + x AS id FROM c WHERE v >= 2),
    l AS (SELECT a.frame, a.id AS a, b.id AS b FROM m a JOIN m b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    r AS (SELECT frame, id, id AS root FROM m UNION SELECT l.frame, l.b, r.root FROM r JOIN l ON l.frame = r.frame AND l.a = r.id),
    p AS (SELECT frame, id, min(root) AS region FROM r GROUP BY ALL),
    w AS (SELECT p.frame::BIGINT AS frame, region::BIGINT AS region, count(*) AS area, avg(x) AS x, avg(y) AS y, max(v) AS peak_z, sum(v) / count(*) AS mean_z, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1,
          max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM p JOIN m ON m.frame = p.frame AND m.id = p.id GROUP BY ALL),
    f AS (SELECT *, area / (width * height) AS fill, greatest(width, height) / least(width, height) AS aspect FROM w),
    n AS (SELECT *, CASE WHEN peak_z < 3 THEN 'no_seed' WHEN area < 2 OR area > 60 THEN 'area' WHEN fill < 0.3 OR aspect > 2.5 THEN 'shape' ELSE 'accepted' END AS reason FROM f),
    o AS (SELECT *, CASE WHEN reason = 'accepted' THEN row_number() OVER (PARTITION BY frame, reason ORDER BY region) END AS component_id FROM n)"""


def _grown(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a day by hour and value as pixels; tiles so small that many regions reach over their rims."""
    rows = events(spark, d).where("day between 0 and 29")
    cells = rows.groupBy(F.col("day").alias("frame"), (F.col("hour") % 24).alias("y"), F.least(F.lit(23), F.floor(F.col("value") / 10)).cast("int").alias("x")).agg(F.count("*").cast("double").alias("v"))
    return regions.grown(cells, 3.0, 2.0, 2, 60, 0.3, 2.5, tile=8)


@query(f"WITH RECURSIVE {_GROWN} SELECT frame, region, component_id, area, round(x, 9) AS x, round(y, 9) AS y, peak_z, round(mean_z, 9) AS mean_z, x0, y0, x1, y1, width, height, round(fill, 9) AS fill, round(aspect, 9) AS aspect, reason FROM o")
def grown_regions(spark: SparkSession, d: str) -> DataFrame:
    return _grown(spark, d).withColumns({c: F.round(c, 9) for c in ("x", "y", "mean_z", "fill", "aspect")})


@query(f"""WITH RECURSIVE {_GROWN} SELECT frame, count(*) FILTER (reason = 'accepted') AS accepted, coalesce(sum(area) FILTER (reason = 'accepted'), 0)::BIGINT AS accepted_pixels,
    count(*) FILTER (reason = 'no_seed') AS rejected_no_seed, count(*) FILTER (reason = 'area') AS rejected_area, count(*) FILTER (reason = 'shape') AS rejected_shape FROM o GROUP BY 1""")
def region_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return regions.frame_outcomes(_grown(spark, d))


@query(f"""WITH {{e}}, {_CELLS}, g AS (SELECT f.r::INT AS frame, y.r::INT AS y, x.r::INT AS x, coalesce(v, 0) AS v FROM (SELECT DISTINCT frame AS r FROM c) f CROSS JOIN range(24) y(r) CROSS JOIN range(24) x(r)
    LEFT JOIN c ON c.frame = f.r AND c.y = y.r AND c.x = x.r), o AS (SELECT a.r AS dy, b.r AS dx FROM range(-4, 5) a(r), range(-4, 5) b(r)),
    s AS (SELECT g.frame, g.y, g.x, g.v, sum(n.v) FILTER (greatest(abs(dy), abs(dx)) > 1) AS s, sum(n.v * n.v) FILTER (greatest(abs(dy), abs(dx)) > 1) AS ss
          FROM g CROSS JOIN o JOIN g n ON n.frame = g.frame AND n.y = greatest(0, least(23, g.y + dy)) AND n.x = greatest(0, least(23, g.x + dx)) GROUP BY ALL),
    z AS (SELECT *, (v - s / 72) / sqrt(greatest(ss / 72 - (s / 72) * (s / 72), 1e-12)) AS score FROM s) SELECT frame, y, x, round(score, 6) AS score FROM z WHERE score >= sqrt(-2 * ln(0.01))""")
def cfar_detections(spark: SparkSession, d: str) -> DataFrame:
    return signal.cfar_detections(_pictures(spark, d), 1, 4, 0.01).withColumn("score", F.round("score", 6))


@query()
def stage_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Peaks of the smoothed pictures' clutter-adaptive scores."""
    from ..sources.readers import long_frames

    scores = images.stage_scores(_pictures(spark, d), images.gamma_decay(1.5), images.gamma_decay(4.0), 9).withColumnRenamed("z", "v")
    return images.peaks(long_frames(scores, 24, 24), 2.0, 2, 3.0, 10).withColumn("v", F.round("v", 4))


@query("""WITH {e}, c AS (SELECT hour AS frame, count(*) AS n FROM e GROUP BY 1), b AS (SELECT min(frame) AS low, max(frame) AS high FROM c)
    SELECT DISTINCT frame FROM (SELECT least(high, greatest(low, g)) AS frame FROM (SELECT unnest([-5, 100, 9999])::INT AS g), b UNION ALL (SELECT frame FROM c ORDER BY n DESC, frame LIMIT 5) UNION ALL (SELECT frame FROM c ORDER BY n, frame LIMIT 5))""")
def review_frames(spark: SparkSession, d: str) -> DataFrame:
    return images.review_frames(events(spark, d).groupBy(F.col("hour").alias("frame")).agg(F.count("*").alias("n")), [-5, 100, 9999], 5)


# --- windows over event time ---


@query("""WITH {e} SELECT event_type, (micros // 21600000000)::BIGINT AS slot, count(*) AS n, round(sum(value), 4) AS total FROM e GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).groupBy("event_type", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    slot = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '2024-01-01 00:00:00', cast(w.start AS TIMESTAMP_NTZ)) div 6")
    return rows.select("event_type", slot.alias("slot"), "n", "total")


@query("""WITH {e}, s AS (SELECT user_id, micros, (coalesce(micros - lag(micros) OVER w, 999999999999) >= 28800000000)::INT AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY micros)),
    g AS (SELECT user_id, micros, sum(starts) OVER (PARTITION BY user_id ORDER BY micros) AS session FROM s)
    SELECT user_id, min(micros) AS first, max(micros) AS last, count(*) AS n FROM g GROUP BY user_id, session""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).groupBy("user_id", F.session_window("ts", "8 hours").alias("w")).agg(F.min("micros").alias("first"), F.max("micros").alias("last"), F.count("*").alias("n"))
    return rows.drop("w")


@query("""WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, 1000000000 + floor(o_totalprice / 500)::BIGINT AS b FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
    u AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), r AS (SELECT x AS id, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.id)
    SELECT id, min(root) AS component FROM r GROUP BY id""")
def components(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    edges = rows.select(F.col("o_custkey").alias("a"), (1_000_000_000 + F.floor(F.col("o_totalprice") / 500)).cast("long").alias("b")).distinct()
    return connected_components(edges)


# --- evidence, proposals, named queues, progress and reviewers' pairs ---

_EVIDENCE = f"""{_CELLS}, g AS (SELECT f.r::INT AS frame, y.r::INT AS y, x.r::INT AS x, coalesce(v, 0) AS v FROM range(30) f(r), range(24) y(r), range(24) x(r) LEFT JOIN c ON c.frame = f.r AND c.y = y.r AND c.x = x.r),
    p AS (SELECT y, x, greatest(0.0, max(v)) AS pk, stddev_pop(v) AS sd, count(*) FILTER (v >= 2)::DOUBLE AS ac FROM g GROUP BY ALL),
    n AS (SELECT a.y, a.x, CASE WHEN stddev_pop(a.v) > 0 AND stddev_pop(b.v) > 0 THEN covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) ELSE 0 END AS r
          FROM g a JOIN g b ON a.frame = b.frame AND abs(a.y - b.y) + abs(a.x - b.x) = 1 GROUP BY a.y, a.x, b.y, b.x),
    co AS (SELECT y, x, (avg(r) + 1) / 2 AS co FROM n GROUP BY ALL),
    bl AS (SELECT DISTINCT y + dy AS y, x + dx AS x FROM p, range(-1, 2) i(dy), range(-1, 2) j(dx) WHERE pk >= 4 AND dy * dy + dx * dx <= 1),
    s AS (SELECT y, x, pk, sd, ac, co, bl.y IS NULL AS free, CASE WHEN bl.y IS NULL THEN pk * (1 + 0.35 * least(1.0, ac / 10)) ELSE 0 END AS un FROM p JOIN co USING (y, x) LEFT JOIN bl USING (y, x)),
    l AS (SELECT count(*) AS n, list_sort(list(pk)) AS pk, list_sort(list(sd)) AS sd, list_sort(list(ac)) AS ac, list_sort(list(co)) AS co, list_sort(list(un)) AS un FROM s),
    k AS (SELECT *, (1 + floor((n - 1) * 0.01 + 0.5))::INT AS i, (1 + floor((n - 1) * 0.995 + 0.5))::INT AS j FROM l),
    u AS (SELECT y, x, free, {", ".join(f"greatest(0.0, least(1.0, (s.{c} - k.{c}[i]) / greatest(1e-6, k.{c}[j] - k.{c}[i]))) AS {c}" for c in ("pk", "sd", "ac", "co", "un"))} FROM s, k),
    w AS (SELECT y, x, greatest(0.0, least(1.0, 0.55 * ac + 0.25 * pk + 0.20 * co)) AS su, CASE WHEN free THEN 0.40 * pk + 0.20 * sd + 0.20 * ac + 0.15 * un + 0.05 * co ELSE 0 END AS di FROM u)"""


@query(f"""WITH {{e}}, {_EVIDENCE} SELECT a.y, a.x, round(avg(b.su), 6)::DOUBLE AS support, round(avg(b.di), 6)::DOUBLE AS discovery FROM w a JOIN w b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL""")
def evidence_maps(spark: SparkSession, d: str) -> DataFrame:
    """Event support and discovery of each pixel of the pictures; pixels that reach 4 stand for known regions."""
    long = signal.pixels(_pictures(spark, d))
    per = evidence.pixel_evidence(long.withColumn("z", F.col("v")), 2.0)
    out = evidence.evidence_maps(per, images.local_correlation(long), evidence.blocked_pixels(per.where("peak_z >= 4"), 1))
    return out.withColumns({c: F.round(c, 6) for c in ("support", "discovery")})


_CLEAR = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"


@query(f"""WITH {_FEATURES}, {_REGION}, a AS (SELECT *, greatest(0.0::DOUBLE, artifact_score - 0.3) AS bg, es / 2 AS compact FROM f2),
    b AS (SELECT *, {_CLEAR.format("0.35 * bg + CASE WHEN lc < 0.45 THEN 0.25 ELSE 0 END + CASE WHEN compact < 0.30 THEN 0.20 ELSE 0 END + CASE WHEN area < 1.5 * 60 THEN 0.10 ELSE 0 END")} AS ra,
          {_CLEAR.format("CASE WHEN elongation > 4 THEN 0.45 ELSE 0 END + CASE WHEN lc < 0.45 THEN 0.25 ELSE 0 END + CASE WHEN peak_z > 45 THEN 0.25 ELSE 0 END")} AS sa FROM a)
    SELECT p_partkey, round(1e-9 + ra, 6)::DOUBLE AS region_artifact, round(1e-9 + {_CLEAR.format(f"0.20 * lc + 0.20 * es + 0.20 * {_unit('trace_snr / 8')} + 0.15 * compact + 0.15 * {_unit('event_count / 8')} + 0.10 * {_unit('peak_z / 30')} - 0.20 * bg - 0.15 * ra")}, 6)::DOUBLE AS region_evidence,
    round(1e-9 + sa, 6)::DOUBLE AS suggestion_artifact, CASE WHEN peak_z <= 2 THEN 'border' WHEN elongation > 4 THEN 'elongated_structure' WHEN peak_z > 45 THEN 'very_bright' ELSE 'none' END AS cue,
    round(1e-9 + {_CLEAR.format("0.25 * artifact_score + 0.25 * lc + 0.25 * es + 0.15 * compact + 0.10 * event_count / 60 - 0.20 * sa")}, 6)::DOUBLE AS suggestion_evidence,
    round(1e-9 + peak_z / greatest(0.04, local_correlation) + 0.4 * event_count, 6)::DOUBLE AS quality, round(1e-9 + CASE WHEN peak_z > 25 THEN 0 ELSE 20 END + 12 * local_correlation + abs(area - 65) / 50 - 0.15 * event_count, 6)::DOUBLE AS unsureness FROM b""")
def evidence_scores(spark: SparkSession, d: str) -> DataFrame:
    rows, c = _region(spark, d)
    c |= {"background_correlation": F.greatest(F.lit(0.0), F.col("artifact_score") - 0.3), "compactness": F.col("es") / 2, "peak_score": F.col("peak_z"), "aspect": F.col("elongation")}
    c |= {"seed_score": F.col("artifact_score"), "active_frames": F.col("event_count"), "noise": F.col("local_correlation")}
    bright = F.col("peak_z") > 45
    region, suggestion = evidence.region_artifact_score(c, 60), evidence.suggestion_artifact_score(c, bright)
    out = {
        "region_artifact": region, "region_evidence": evidence.region_evidence(c, region, 30.0), "suggestion_artifact": suggestion,
        "suggestion_evidence": evidence.suggestion_evidence(c, suggestion, 60), "quality": evidence.quality(c), "unsureness": evidence.unsureness(c, F.col("peak_z") > 25),
    }
    return rows.select("p_partkey", evidence.suggestion_cue(c, F.col("peak_z") <= 2, bright).alias("cue"), *[F.round(v + 1e-9, 6).alias(k) for k, v in out.items()])


_PROPOSED = f"""{_FEATURES}, {_REGION}, a AS (SELECT *, list_filter([CASE WHEN artifact_score >= 0.4 THEN 'artifact score' END, CASE WHEN lc > 0 AND lc < 0.35 THEN 'low local coherence' END, CASE WHEN area <> 0 AND area < 8 THEN 'too small' END,
    CASE WHEN area >= 180 THEN 'large or merged' END, CASE WHEN elongation >= 5 THEN 'elongated' END, CASE WHEN peak_z <= 2 OR peak_z >= 48 THEN 'near border' END], lambda x: x IS NOT NULL) AS cues FROM f2),
    r AS (SELECT *, list_filter(['uncovered discovery suggestion', CASE WHEN es >= 0.35 THEN 'event-supported' END, CASE WHEN lc >= 0.45 THEN 'locally coherent' END, CASE WHEN trace_snr >= 3 THEN 'strong positive evidence' END,
    CASE WHEN event_count >= 4 THEN 'repeated activity' END, CASE WHEN len(cues) > 0 THEN 'artifact cue: ' || array_to_string(cues[1:3], ', ') END, CASE WHEN peak_z > 45 THEN 'annotation: rejected' END], lambda x: x IS NOT NULL) AS why FROM a)"""


def _proposed(spark: SparkSession, d: str) -> DataFrame:
    rows, c = _region(spark, d)
    c |= {"max_z": F.col("trace_snr"), "active_frames": F.col("event_count")}
    z = F.col("peak_z")
    border = proposals.near_border([z - 1, F.lit(10), z + 1, F.lit(20)], F.lit(51), F.lit(99))
    none = F.lit(None).cast("string")
    rows = rows.withColumn("cues", scoring.artifact_reasons(c, border, none, none))
    state = F.when(z > 45, "rejected").otherwise("")
    score = scoring.proposal_score(c | {"priority": F.col("es")}, border, state)
    return rows.withColumns({"why": proposals.proposal_reasons(c, F.col("cues"), state), "risk": scoring.artifact_risk(c, border, F.lit(False)), "score": score})


@query(f"WITH {_PROPOSED}, t AS (SELECT 'artifact' AS kind, unnest(cues) AS reason FROM r UNION ALL SELECT 'proposal', unnest(why) FROM r) SELECT kind, reason, count(*) AS n FROM t GROUP BY ALL")
def proposal_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = _proposed(spark, d)
    return proposals.reason_counts(rows, "cues").withColumn("kind", F.lit("artifact")).unionByName(proposals.reason_counts(rows, "why").withColumn("kind", F.lit("proposal")))


_RISK = f"""greatest(0, least(1, 0.45 * {_unit("artifact_score")} + CASE WHEN lc > 0 THEN 0.15 * {_unit("(0.40 - lc) / 0.40")} ELSE 0 END + 0.10 * {_unit("(area - 140) / 160")} + CASE WHEN area > 0 THEN 0.08 * {_unit("(8 - area) / 8")} ELSE 0 END
    + 0.10 * {_unit("(elongation - 3) / 4")} + CASE WHEN trace_snr > 0 THEN 0.08 * {_unit("(1.5 - trace_snr) / 1.5")} ELSE 0 END + CASE WHEN peak_z <= 2 OR peak_z >= 48 THEN 0.08 ELSE 0 END))"""
_PROPOSAL = f"""greatest(0, least(1, 0.35 * {_unit("es")} + 0.20 * {_unit("es")} + 0.18 * {_unit("es")} + 0.14 * {_unit("lc")} + 0.06 * {_unit("trace_snr / 6")} + 0.04 * {_unit("event_count / 20")} - 0.22 * {_unit("artifact_score")}
    - 0.08 * {_unit("(area - 180) / 180")} - 0.08 * {_unit("(elongation - 3) / 4")} - CASE WHEN peak_z <= 2 OR peak_z >= 48 THEN 0.05 ELSE 0 END - CASE WHEN peak_z > 45 THEN 0.35 ELSE 0 END))"""


@query(f"""WITH {_PROPOSED} SELECT count(*) AS region_count, count(*) FILTER (round({_RISK} + 1e-9, 6) >= 0.4) AS high_risk_count, count(*) AS proposal_count, least(50, count(*)) AS shown_count,
    count(*) FILTER (round({_PROPOSAL} + 1e-9, 6) >= 0.65) AS high_confidence_count, count(*) FILTER (len(cues) > 0) AS artifact_cued_count FROM r""")
def proposal_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _proposed(spark, d).withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("risk", "score")}).withColumn("cue", F.try_element_at("cues", F.lit(1)))
    return proposals.analysis_summary(rows, "risk", rows, "score", "cue", 50).withColumn("shown_count", F.col("shown_count").cast("long"))


@query(f"WITH {_PROPOSED}, s AS (SELECT p_partkey, round({_PROPOSAL} + 1e-9, 6)::DOUBLE AS score, array_to_string(why, '; ') AS why FROM r) SELECT * FROM s ORDER BY score DESC, p_partkey LIMIT 50")
def best_proposals(spark: SparkSession, d: str) -> DataFrame:
    """The fifty suggestions with the highest scores."""
    rows = _proposed(spark, d).select("p_partkey", F.round(F.col("score") + 1e-9, 6).alias("score"), F.array_join("why", "; ").alias("why"))
    return proposals.best(rows, ["score"], "p_partkey", 50)


_LOOKED = f"""{_FEATURES}, rg AS (SELECT p_partkey, round({_SCORE}, 6)::DOUBLE AS score, artifact_score, ['', 'accepted', 'rejected', 'Unsure', 'promoted'][1 + (p_partkey % 5)::INT] AS state, ['high', 'medium', 'low', ''][1 + (p_partkey % 4)::INT] AS confidence,
    CASE WHEN p_partkey % 11 = 0 THEN 'Second look' END AS act FROM f),
    ev AS (SELECT l_orderkey || ':' || l_linenumber AS id, round(score + 0.4 * l_tax, 6)::DOUBLE AS score, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'unsure' ELSE '' END AS state, CASE WHEN l_linenumber = 7 THEN 'second_review' END AS tag FROM lineitem JOIN rg ON l_partkey = p_partkey),
    sg AS (SELECT s_suppkey AS id, s_acctbal AS score, CASE s_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'missed' ELSE 'artifact' END AS state, CASE WHEN s_nationkey % 4 = 0 THEN 'border' ELSE 'none' END AS cue FROM supplier)"""


def _looked_at(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, _ = _region(spark, d)
    own = {name: F.col(name) for name in candidates.PRIORITY_TERMS}
    pick = lambda texts, k: F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % k).cast("int") + 1)
    found = rows.select(
        "p_partkey", X.rounded(candidates.priority(own, F.col("peak_z")), 6).alias("score"), "artifact_score", pick(["", "accepted", "rejected", "Unsure", "promoted"], 5).alias("state"),
        pick(["high", "medium", "low", ""], 4).alias("confidence"), F.when(F.col("p_partkey") % 11 == 0, "Second look").alias("act"),
    )
    flag = F.col("l_returnflag")
    at = table(spark, d, "lineitem").join(found.select("p_partkey", "score"), F.col("l_partkey") == F.col("p_partkey"))
    happened = at.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.round(review.event_queue_score(F.col("score"), F.col("l_tax")), 6).alias("score"),
        F.when(flag == "A", "accepted").when(flag == "R", "unsure").otherwise("").alias("state"), F.when(F.col("l_linenumber") == 7, F.array(F.lit("second_review"))).alias("tags"),
    )
    n = F.col("s_nationkey")
    offered = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.when(n % 3 == 0, "").when(n % 3 == 1, "missed").otherwise("artifact").alias("state"), F.when(n % 4 == 0, "border").otherwise("none").alias("cue")
    )
    return found, happened, offered


@query(f"""WITH {_LOOKED}, m AS (
    SELECT unnest([CASE WHEN lower(state) NOT IN ('accepted', 'rejected', 'unsure') THEN 'unreviewed_high_priority' END, CASE WHEN state = 'Unsure' OR confidence IN ('low', 'medium') THEN 'uncertain' END, CASE WHEN artifact_score >= 0.4 THEN 'likely_artifact' END,
        CASE WHEN act IS NOT NULL OR confidence = 'low' THEN 'needs_second_reviewer' END]) AS queue, 'region' AS subject_type, p_partkey::VARCHAR AS subject_id, score FROM rg
    UNION ALL SELECT unnest([CASE WHEN state = 'unsure' THEN 'uncertain' END, CASE WHEN tag IS NOT NULL THEN 'needs_second_reviewer' END]), 'event', id, score FROM ev
    UNION ALL SELECT unnest([CASE WHEN state <> 'artifact' AND cue = 'none' THEN 'possible_missed_neuron' END, CASE WHEN state = 'artifact' OR cue <> 'none' THEN 'likely_artifact' END]), 'suggestion', id::VARCHAR, score FROM sg)
    SELECT queue, subject_type, subject_id, score, row_number() OVER (PARTITION BY queue ORDER BY score DESC, subject_type, subject_id) AS place, count(*) OVER (PARTITION BY queue) AS queue_length FROM m WHERE queue IS NOT NULL QUALIFY place <= 30""")
def named_queues(spark: SparkSession, d: str) -> DataFrame:
    """The five guided queues over regions, events and suggestions, thirty places each."""
    found, happened, offered = _looked_at(spark, d)
    none, no_tags, c = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.col
    regions_ = review.region_queues({"state": c("state"), "confidence": c("confidence"), "artifact_score": c("artifact_score"), "artifact_class": none, "needs_action": c("act"), "reason_tags": no_tags})
    events_ = review.event_queues({"state": c("state"), "confidence": none, "needs_action": none, "reason_tags": c("tags")})
    offered_ = review.suggestion_queues({"state": c("state"), "confidence": none, "artifact_score": F.lit(0.0), "artifact_cue": c("cue"), "needs_action": none, "reason_tags": no_tags})
    parts = [("region", found, c("p_partkey"), c("score"), regions_), ("event", happened, c("id"), c("score"), events_), ("suggestion", offered, c("id"), c("score"), offered_)]
    return review.guided_items(parts, 30).withColumn("place", c("place").cast("long"))


@query(f"""WITH {_LOOKED}, r AS (SELECT count(*) AS n, count(*) FILTER (lower(state) IN ('accepted', 'rejected', 'unsure')) AS reviewed_regions, count(*) FILTER (state = 'accepted') AS accepted_regions, count(*) FILTER (state = 'rejected') AS rejected_regions FROM rg),
    v AS (SELECT count(*) AS m, count(*) FILTER (state IN ('accepted', 'rejected', 'unsure')) AS reviewed_events, count(*) FILTER (state = 'accepted') AS accepted_events, count(*) FILTER (state = 'rejected') AS rejected_events FROM ev),
    s AS (SELECT count(*) AS k, count(*) FILTER (state <> '' OR cue = 'border') AS reviewed_suggestions FROM sg)
    SELECT * EXCLUDE (n, m, k), reviewed_regions / greatest(1, n) AS region_review_share, reviewed_events / greatest(1, m) AS event_review_share, reviewed_suggestions / greatest(1, k) AS suggestion_review_share,
    (reviewed_regions >= 20 AND reviewed_events >= 20)::INT AS tuning_ready FROM r, v, s""")
def review_progress(spark: SparkSession, d: str) -> DataFrame:
    found, happened, offered = _looked_at(spark, d)
    out = review.review_progress(found, happened, offered.withColumn("promoted", F.col("cue") == "border"), "state", "promoted")
    return out.withColumn("tuning_ready", F.col("tuning_ready").cast("int"))


_TWO = """fa AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'rejected' ELSE '' END AS label, CASE WHEN o_orderpriority LIKE '1%' THEN 'high' WHEN o_orderpriority LIKE '5%' THEN 'low' ELSE 'unlabeled' END AS conf,
        CASE WHEN o_totalprice > 300000 THEN 'motion' ELSE 'none' END AS art FROM orders WHERE o_orderkey % 7 <> 0),
    fb AS (SELECT l_orderkey AS o_orderkey, CASE max(l_returnflag) WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'unlabeled' END AS label, CASE WHEN count(*) > 5 THEN 'high' ELSE 'medium' END AS conf, CASE WHEN max(l_tax) > 0.07 THEN 'vessel' ELSE 'none' END AS art FROM lineitem GROUP BY 1),
    j AS (SELECT coalesce(fa.o_orderkey, fb.o_orderkey) AS o_orderkey, coalesce(fa.label, '') AS label_a, coalesce(fb.label, '') AS label_b, coalesce(fa.conf, 'unlabeled') AS confidence_a, coalesce(fb.conf, 'unlabeled') AS confidence_b,
          coalesce(fa.art, 'none') AS artifact_a, coalesce(fb.art, 'none') AS artifact_b, label_a NOT IN ('', 'unlabeled') AND label_b NOT IN ('', 'unlabeled') AS both_labeled FROM fa FULL JOIN fb ON fa.o_orderkey = fb.o_orderkey)"""


def _two_reviewers(spark: SparkSession, d: str) -> DataFrame:
    status, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")
    a = table(spark, d, "orders").where("o_orderkey % 7 <> 0").select(  # the rest is what the first reviewer has not seen
        "o_orderkey", F.when(status == "F", "accepted").when(status == "O", "Rejected ").alias("state"), F.when(urgency.startswith("1"), "high").when(urgency.startswith("5"), "low").alias("confidence"),
        F.when(F.col("o_totalprice") > 300000, "motion").alias("artifact"),
    )
    flag = F.max("l_returnflag")
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.when(flag == "A", "accepted").when(flag == "R", "rejected").otherwise("unlabeled").alias("state"), F.when(F.count("*") > 5, "high").otherwise("medium").alias("confidence"),
        F.when(F.max("l_tax") > 0.07, "vessel").alias("artifact"),
    )
    return review.compared(a, b, ["o_orderkey"], "state", "confidence", "artifact")


@query(f"""WITH {_TWO} SELECT 'confidence' AS kind, confidence_a || ' / ' || confidence_b AS pair, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT 'artifact', artifact_a || ' / ' || artifact_b, count(*) FROM j GROUP BY ALL
    UNION ALL SELECT 'label', label_a || ' / ' || label_b, count(*) FROM j WHERE both_labeled GROUP BY ALL""")
def pair_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    return review.pair_breakdowns(_two_reviewers(spark, d))


@query(f"""WITH {_TWO} SELECT o_orderkey, 'first' AS reviewer_a, 'second' AS reviewer_b, both_labeled::INT AS both_labeled, (both_labeled AND label_a = label_b)::INT AS exact_agreement, label_a, label_b, confidence_a, confidence_b, artifact_a, artifact_b
    FROM j WHERE NOT (both_labeled AND label_a = label_b)""")
def disagreement_rows(spark: SparkSession, d: str) -> DataFrame:
    return review.disagreement_rows(_two_reviewers(spark, d), ["o_orderkey"], ("first", "second"))
