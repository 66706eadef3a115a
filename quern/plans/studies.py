"""Sampling, metrics, routing, authors, vectors and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.numeric import blend_logits, clopper_pearson_upper, normalised, prefix, rate, token_ranges
from quern.operators import authors, metrics, relational, routing, sampling, segment, similarity
from quern.session import table

def _p():
    """A pseudo-probability from the id's hash, until a model scores rows: the first eight hex digits over 16 ** 8, to four places."""
    return F.round(F.conv(F.substring(F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("double") / float(16**8), 4)


_P_SQL = "round(CAST(CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[1:8] AS BIGINT) AS DOUBLE) / 4294967296.0, 4)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", _p().alias("p"))


def stratified_hash_sample(spark, sf_dir):
    drawn = sampling.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", "seed-1", 20)
    return drawn.select("lang", "doc_id", "rank", "stratum_size", F.round("inclusion", 6).alias("inclusion"), F.round("weight", 6).alias("weight"))


def queue_rank(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.global_rank(docs, sampling.hash_order("queue", "doc_id"), "doc_id")


def batch_numbers(spark, sf_dir):
    """Batches of 500 in rank order."""
    ranked = queue_rank(spark, sf_dir).withColumn("batch", F.floor((F.col("queue_rank") - 1) / 500))
    return ranked.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("queue_rank").alias("first_rank"))


def quantile_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sampling.quantile_rows(docs, "source", ["n_chars", "doc_id"], 5)


def temporal_tail(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), "o_custkey")
    return sampling.temporal_test_tail(rows, "d", "o_orderkey", "o_custkey", 0.2, "t").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("components"))


def round_robin_sources(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", sampling.hash_order("rr", "doc_id"), "doc_id", 50).select("doc_id", "source", F.col("turn").cast("bigint").alias("turn"))


def hash_folds(spark, sf_dir):
    return sampling.hash_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, "f").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def confusion(spark, sf_dir):
    out = metrics.confusion(_scored(spark, sf_dir), "toxic", "p", 0.5)
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def brier_logloss(spark, sf_dir):
    out = metrics.brier_and_log_loss(_scored(spark, sf_dir), "toxic", "p")
    return out.select(F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


def average_precision(spark, sf_dir):
    return metrics.average_precision(_scored(spark, sf_dir), "toxic", "p").select(F.round("average_precision", 6).alias("average_precision"))


def weighted_rates(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("w", (1 + F.col("doc_id") % 3).cast("double"))
    return metrics.weighted_rates(rows, F.col("toxic") == 1, F.col("p") >= 0.3, "w").select(F.round("weighted_rate", 6).alias("weighted_rate"), F.round("raw_rate", 6).alias("raw_rate"), F.round("effective_n", 6).alias("effective_n"))


def risk_coverage(spark, sf_dir):
    out = metrics.risk_coverage(_scored(spark, sf_dir), "toxic", "p", [0.5, 0.6, 0.7, 0.8, 0.9])
    return out.select("confidence", "kept", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


def alpha_nominal(spark, sf_dir):
    pairs = table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return metrics.nominal_alpha(pairs, "a", "b").select("pairs", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "alpha")))


def coder_crosstab(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality").pivot("toxic", [0, 1]).agg(F.count(F.lit(1))).select("quality", F.coalesce("0", F.lit(0)).alias("toxic_0"), F.coalesce("1", F.lit(0)).alias("toxic_1"))


def band_errors(spark, sf_dir):
    rows = _scored(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return metrics.band_errors(rows, routing.length_band(F.col("n_chars")), "toxic", "p", "n_chars")


def group_report(spark, sf_dir):
    """One row for all and one per length band: the report's grouping sets."""
    docs = table(spark, sf_dir, "documents").withColumn("band", routing.length_band(F.col("n_chars")).cast("string"))
    out = docs.rollup("band").agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean"), F.percentile("n_chars", 0.5).alias("median"))
    return out.withColumn("band", F.coalesce("band", F.lit("all")))


def tail_bounds(spark, sf_dir):
    """Adverse events of both tails with exact upper bounds."""
    routed = _scored(spark, sf_dir).withColumn("action", routing.route(F.col("p"), 0.31, 0.96))
    bad = F.when(F.col("action") == "auto_keep", F.col("toxic")).when(F.col("action") == "auto_exclude", 1 - F.col("toxic")).otherwise(0)
    out = routed.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sum(bad).alias("events"))
    return out.withColumn("upper", F.round(clopper_pearson_upper(0.95)(F.col("events"), F.col("n")), 6))


def route_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", _p().alias("p"))
    return docs.groupBy("source", routing.route(F.col("p"), 0.31, 0.96).alias("action")).agg(F.count(F.lit(1)).alias("n"))


def joint_strata(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("q", 1 - F.col("p") * 0.7)
    return rows.groupBy(routing.joint_stratum(F.col("p"), F.col("q")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def fused_scores(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("q", 1 - F.col("p") * 0.7)
    return rows.select("doc_id", F.round(blend_logits(F.col("p"), F.col("q"), 0.25), 6).alias("fused"))


def threshold_grid(spark, sf_dir):
    out = routing.threshold_grid(_scored(spark, sf_dir), "p", F.col("toxic") == 1, F.col("toxic") == 0, 20)
    return out.withColumns({c: F.round(c, 6) for c in ("keep_risk", "exclude_risk")})


def pareto_points(spark, sf_dir):
    grid = threshold_grid(spark, sf_dir).where("keep_risk is not null and exclude_risk is not null")
    return routing.pareto(grid, ["keep_risk", "exclude_risk", "manual_n"], ["keep_step", "exclude_step"])


def best_policy(spark, sf_dir):
    grid = threshold_grid(spark, sf_dir)
    return routing.best_policy(grid, F.col("keep_risk") <= 0.2, [F.col("manual_n"), F.col("keep_risk"), F.col("keep_step"), F.col("exclude_step")]).select("keep_step", "exclude_step", "manual_n", "keep_risk")


def nearest_workload(spark, sf_dir):
    grid = threshold_grid(spark, sf_dir).withColumn("manual_rate", F.round(F.col("manual_n") / (F.col("manual_n") + F.col("keep_n") + F.col("exclude_n")), 6))
    return routing.nearest_workload(grid, "manual_rate", [0.1, 0.2, 0.3], ["keep_step", "exclude_step"])


def author_coverage(spark, sf_dir):
    posts = table(spark, sf_dir, "events").withColumns({"author": F.col("user_id"), "platform": F.col("event_type")})
    rolled = authors.roll_up(posts, "platform", "author", F.to_date("ts"), F.col("value") > 50)
    return rolled.select("platform_key", "author_id", "posts", "distinct_days", "span_days", "has_profile", authors.author_stratum(F.col("distinct_days"), F.col("span_days"), F.col("has_profile")).alias("stratum"))


def two_level_rates(spark, sf_dir):
    rolled = author_coverage(spark, sf_dir)
    return authors.coverage(rolled, {"profile": F.col("has_profile"), "repeat": F.col("posts") > 1, "long": F.col("span_days") >= 10})


def cosine_topk(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings")
    return similarity.cosine_top_k(items.where("vec_id % 20 = 0"), items, "vec_id", "embedding", 5)


def centroid_cosine(spark, sf_dir):
    return similarity.centroid_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("id", "cluster", F.round("similarity", 5).alias("similarity"))


def mrl_prefix(spark, sf_dir):
    items = table(spark, sf_dir, "embeddings").select("vec_id", prefix(F.col("embedding"), 16).alias("v"), normalised(F.col("embedding")).alias("w"))
    return items.select("vec_id", F.size("v").alias("dimension"), F.round(F.col("v")[0], 5).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm"), F.round(F.col("w")[0], 5).alias("full_first"))


def token_spans(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(token_ranges(F.length("text"), 500)).alias("r"))
    return docs.select("doc_id", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


def segments(spark, sf_dir):
    return segment.segments(table(spark, sf_dir, "documents"), "doc_id", "text", "b1")


def segment_coverage_check(spark, sf_dir):
    """For each post the characters that its segments hold, whether they keep the loss-less contract, and its segments' numbers' sum."""
    arrays = segment.segment_arrays(table(spark, sf_dir, "documents"), "doc_id", "text")
    return segment.coverage(arrays).withColumnRenamed("source_post_id", "doc_id")


def platform_pivot(spark, sf_dir):
    routed = table(spark, sf_dir, "documents").select("lang", routing.route(_p(), 0.31, 0.96).alias("a"))
    return routed.groupBy("lang").pivot("a", list(routing.ACTIONS)).agg(F.count(F.lit(1))).na.fill(0)


def label_rates(spark, sf_dir):
    marked = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = marked.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return out.select("lang", "n", "labelled", rate(F.col("toxic"), F.col("labelled")).alias("toxic_rate"))


def incremental_changes(spark, sf_dir):
    """What a second batch would change: rows by input_change."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    old = docs.where("doc_id % 2 = 0").withColumn("version", F.lit(1).cast("bigint"))
    return relational.versioned(docs, old, "doc_id", ["lang", "source"], "version").groupBy("input_change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    stratified_hash_sample, queue_rank, batch_numbers, quantile_rows, temporal_tail, round_robin_sources, hash_folds, confusion, brier_logloss, average_precision, weighted_rates, risk_coverage, alpha_nominal, coder_crosstab,
    band_errors, group_report, tail_bounds, route_counts, joint_strata, fused_scores, threshold_grid, pareto_points, best_policy, nearest_workload, author_coverage, two_level_rates, cosine_topk, centroid_cosine, mrl_prefix,
    token_spans, segments, segment_coverage_check, platform_pivot, label_rates, incremental_changes,
)}

_S = f"s AS (SELECT doc_id, quality, toxic, {_P_SQL} AS p FROM labels)"
_ROUTE = "CASE WHEN p <= 0.31 THEN 'auto_keep' WHEN p >= 0.96 THEN 'auto_exclude' ELSE 'manual_review' END"
_BAND = "CASE WHEN n_chars >= 400 THEN 4 WHEN n_chars >= 150 THEN 3 WHEN n_chars >= 60 THEN 2 WHEN n_chars >= 20 THEN 1 ELSE 0 END"
_JOINT = """CASE WHEN p >= 0.9 AND q >= 0.9 THEN 'both_p_ge_0_90' WHEN q >= 0.9 THEN 'qwen_only_p_ge_0_90' WHEN p >= 0.9 THEN 'sparse_only_p_ge_0_90'
  WHEN (p >= 0.5) <> (q >= 0.5) THEN 'action_disagreement_at_0_50' WHEN p >= 0.5 AND q >= 0.5 THEN 'both_p_ge_0_50_remainder' ELSE 'both_p_lt_0_50' END"""
_GRID = f"""{_S}, k AS (SELECT CAST(unnest(range(1, 20)) AS INTEGER) AS step),
g AS (SELECT a.step AS keep_step, b.step AS exclude_step, count(*) FILTER (p <= a.step / 20.0) AS keep_n, count(*) FILTER (p >= b.step / 20.0) AS exclude_n, count(*) FILTER (p > a.step / 20.0 AND p < b.step / 20.0) AS manual_n,
  count(*) FILTER (p <= a.step / 20.0 AND toxic = 1) AS keep_bad, count(*) FILTER (p >= b.step / 20.0 AND toxic = 0) AS exclude_bad FROM k a, k b, s WHERE a.step < b.step GROUP BY 1, 2),
grid AS (SELECT *, round(keep_bad / nullif(CAST(keep_n AS DOUBLE), 0), 6) AS keep_risk, round(exclude_bad / nullif(CAST(exclude_n AS DOUBLE), 0), 6) AS exclude_risk FROM g)"""
_AUTHORS = """a AS (SELECT event_type AS platform_key, user_id AS author_id, count(*) AS posts, count(DISTINCT CAST(ts AS DATE)) AS distinct_days, CAST(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS BIGINT) AS span_days,
  bool_or(coalesce(value > 50, false)) AS has_profile FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2)"""

ORACLES = {
    "stratified_hash_sample": """
WITH d AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-1:' || doc_id), doc_id) AS rank, count(*) OVER (PARTITION BY lang) AS stratum_size FROM documents)
SELECT lang, doc_id, CAST(rank AS INTEGER) AS rank, stratum_size, round(least(stratum_size, 20) / CAST(stratum_size AS DOUBLE), 6) AS inclusion, round(stratum_size / CAST(least(stratum_size, 20) AS DOUBLE), 6) AS weight FROM d WHERE rank <= 20""",
    "queue_rank": "SELECT doc_id, row_number() OVER (ORDER BY sha256('queue:' || doc_id), doc_id) AS queue_rank FROM documents",
    "batch_numbers": "SELECT CAST(floor((r - 1) / 500) AS BIGINT) AS batch, count(*) AS n, min(r) AS first_rank FROM (SELECT row_number() OVER (ORDER BY sha256('queue:' || doc_id), doc_id) AS r FROM documents) GROUP BY 1",
    "quantile_rows": """
WITH d AS (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, n_chars, i AS position FROM d WHERE n <= 5 OR i IN (0, round_even((n - 1) / 4.0, 0), round_even(2 * (n - 1) / 4.0, 0), round_even(3 * (n - 1) / 4.0, 0), n - 1)""",
    "temporal_tail": """
WITH d AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC, sha256('t:' || o_orderkey) DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders),
t AS (SELECT DISTINCT o_custkey FROM d WHERE r <= ceil(n * 0.2))
SELECT CASE WHEN t.o_custkey IS NOT NULL THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT d.o_custkey) AS components FROM d LEFT JOIN t ON d.o_custkey = t.o_custkey GROUP BY 1""",
    "round_robin_sources": """
SELECT doc_id, source, turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('rr:' || doc_id), doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50""",
    "hash_folds": "SELECT CAST(CAST('0x' || sha256('f:' || source)[1:8] AS BIGINT) % 5 AS INTEGER) AS fold, count(*) AS n FROM documents GROUP BY 1",
    "confusion": f"""
WITH {_S}, c AS (SELECT count(*) FILTER (toxic = 1 AND p >= 0.5) AS tp, count(*) FILTER (toxic <> 1 AND p >= 0.5) AS fp, count(*) FILTER (toxic = 1 AND p < 0.5) AS fn, count(*) FILTER (toxic <> 1 AND p < 0.5) AS tn FROM s)
SELECT tp, fp, fn, tn, coalesce(round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6), 0.0) AS precision, coalesce(round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6), 0.0) AS recall, coalesce(round(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 6), 0.0) AS f1 FROM c""",
    "brier_logloss": f"""
WITH {_S}, c AS (SELECT *, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM s)
SELECT round(avg((p - toxic) * (p - toxic)), 6) AS brier, round(avg(CASE WHEN toxic = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS log_loss FROM c""",
    "average_precision": f"""
WITH {_S}, t AS (SELECT p, count(*) FILTER (toxic = 1) AS pos, count(*) AS n FROM s GROUP BY p),
c AS (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM t WINDOW w AS (ORDER BY p DESC))
SELECT round(sum(pos * CAST(cp AS DOUBLE) / cn) / sum(pos), 6) AS average_precision FROM c""",
    "weighted_rates": f"""
WITH {_S}, w AS (SELECT *, CAST(1 + doc_id % 3 AS DOUBLE) AS w FROM s WHERE p >= 0.3)
SELECT round(sum(w) FILTER (toxic = 1) / sum(w), 6) AS weighted_rate, round(count(*) FILTER (toxic = 1) / CAST(count(*) AS DOUBLE), 6) AS raw_rate, round(sum(w) * sum(w) / sum(w * w), 6) AS effective_n FROM w""",
    "risk_coverage": f"""
WITH {_S}, g AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS confidence), c AS (SELECT greatest(p, 1 - p) AS sure, (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) <> toxic AS wrong FROM s)
SELECT confidence, count(*) FILTER (sure >= confidence) AS kept, round(count(*) FILTER (sure >= confidence) / CAST(count(*) AS DOUBLE), 6) AS coverage,
  round(count(*) FILTER (sure >= confidence AND wrong) / nullif(CAST(count(*) FILTER (sure >= confidence) AS DOUBLE), 0), 6) AS risk FROM g, c GROUP BY confidence""",
    "alpha_nominal": """
WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels), o AS (SELECT count(*) AS pairs, avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END) AS observed FROM p),
v AS (SELECT v, count(*) AS c FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p) GROUP BY v), e AS (SELECT 1 - sum(CAST(c AS DOUBLE) * (c - 1)) / (sum(c) * (sum(c) - 1)) AS expected FROM v)
SELECT pairs, round(observed, 6) AS observed, round(expected, 6) AS expected, round(CASE WHEN expected > 0 THEN 1 - observed / expected ELSE 1.0 END, 6) AS alpha FROM o, e""",
    "coder_crosstab": "SELECT quality, count(*) FILTER (toxic = 0) AS toxic_0, count(*) FILTER (toxic = 1) AS toxic_1 FROM labels GROUP BY quality",
    "band_errors": f"""
WITH {_S} SELECT CAST({_BAND} AS INTEGER) AS band, count(*) AS n, CAST(sum(CASE WHEN (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) <> toxic THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(toxic) AS BIGINT) AS positives,
  CAST(quantile_cont(n_chars, 0.5) AS DOUBLE) AS median_length FROM s JOIN documents USING (doc_id) GROUP BY 1""",
    "group_report": f"""
SELECT coalesce(CAST(band AS VARCHAR), 'all') AS band, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, CAST(quantile_cont(n_chars, 0.5) AS DOUBLE) AS median
FROM (SELECT n_chars, {_BAND} AS band FROM documents) GROUP BY ROLLUP (band)""",
    "route_counts": f"SELECT source, {_ROUTE} AS action, count(*) AS n FROM (SELECT source, {_P_SQL} AS p FROM documents) GROUP BY 1, 2",
    "joint_strata": f"WITH {_S}, j AS (SELECT p, 1 - p * 0.7 AS q FROM s) SELECT {_JOINT} AS stratum, count(*) AS n FROM j GROUP BY 1",
    "fused_scores": f"""
WITH {_S}, j AS (SELECT doc_id, greatest(least(p, 1 - 1e-6), 1e-6) AS p, greatest(least(1 - p * 0.7, 1 - 1e-6), 1e-6) AS q FROM s)
SELECT doc_id, round(1 / (1 + exp(-(0.25 * ln(p / (1 - p)) + 0.75 * ln(q / (1 - q))))), 6) AS fused FROM j""",
    "threshold_grid": f"WITH {_GRID} SELECT * FROM grid",
    "pareto_points": f"""
WITH {_GRID}, p AS (SELECT keep_step, exclude_step, keep_risk, exclude_risk, manual_n FROM grid WHERE keep_risk IS NOT NULL AND exclude_risk IS NOT NULL)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.keep_risk <= p.keep_risk AND b.exclude_risk <= p.exclude_risk AND b.manual_n <= p.manual_n AND (b.keep_risk < p.keep_risk OR b.exclude_risk < p.exclude_risk OR b.manual_n < p.manual_n))""",
    "best_policy": f"WITH {_GRID} SELECT keep_step, exclude_step, manual_n, keep_risk FROM grid WHERE keep_risk <= 0.2 ORDER BY manual_n, keep_risk, keep_step, exclude_step LIMIT 1",
    "nearest_workload": f"""
WITH {_GRID}, m AS (SELECT keep_step, exclude_step, round(manual_n / CAST(manual_n + keep_n + exclude_n AS DOUBLE), 6) AS manual_rate FROM grid), t AS (SELECT unnest([0.1, 0.2, 0.3])::DOUBLE AS target)
SELECT target, keep_step, exclude_step, manual_rate FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(manual_rate - target), keep_step, exclude_step) AS r FROM m, t) WHERE r = 1""",
    "author_coverage": f"WITH {_AUTHORS} SELECT *, CASE WHEN distinct_days >= 3 AND span_days >= 30 AND has_profile THEN 'HISTORY_RICH' WHEN (distinct_days >= 3 AND span_days >= 30) OR has_profile THEN 'BOUNDARY' ELSE 'RANDOM_FRAME' END AS stratum FROM a",
    "two_level_rates": f"""
WITH {_AUTHORS} SELECT platform_key, count(*) AS authors, count(*) FILTER (has_profile) AS profile_n, round(count(*) FILTER (has_profile) / CAST(count(*) AS DOUBLE), 6) AS profile_rate, count(*) FILTER (posts > 1) AS repeat_n,
  round(count(*) FILTER (posts > 1) / CAST(count(*) AS DOUBLE), 6) AS repeat_rate, count(*) FILTER (span_days >= 10) AS long_n, round(count(*) FILTER (span_days >= 10) / CAST(count(*) AS DOUBLE), 6) AS long_rate FROM a GROUP BY 1""",
    "token_spans": "SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(least(s + 500, length(text)) AS INTEGER) AS \"end\" FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS s FROM documents)",
    "segment_coverage_check": r"SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '\s', '', 'g')) AS BIGINT) AS held, true AS gapless, true AS lossless FROM documents",
    "mrl_prefix": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, CAST(16 AS INTEGER) AS dimension, round(e[1] / sqrt(list_inner_product(e[1:16], e[1:16])), 5) AS first, 1.0::DOUBLE AS norm, round(e[1] / sqrt(list_inner_product(e, e)), 5) AS full_first FROM v""",
    "cosine_topk": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
m AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.e, i.e), 6) AS similarity FROM v q, v i WHERE q.vec_id % 20 = 0 AND q.vec_id <> i.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, item_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM m) WHERE rank <= 5""",
    "centroid_cosine": """
WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, label, i, e[i] / sqrt(list_inner_product(e, e)) AS x FROM v, (SELECT unnest(range(1, 65)) AS i)),
c AS (SELECT label, i, avg(x) AS m FROM u GROUP BY 1, 2), k AS (SELECT label, sqrt(sum(m * m)) AS len FROM c GROUP BY 1)
SELECT vec_id AS id, u.label AS cluster, round(sum(x * m) / any_value(len), 5) AS similarity FROM u JOIN c ON u.label = c.label AND u.i = c.i JOIN k ON u.label = k.label GROUP BY 1, 2""",
    "platform_pivot": f"""
SELECT lang, count(*) FILTER (a = 'auto_keep') AS auto_keep, count(*) FILTER (a = 'manual_review') AS manual_review, count(*) FILTER (a = 'auto_exclude') AS auto_exclude
FROM (SELECT lang, {_ROUTE} AS a FROM (SELECT lang, {_P_SQL} AS p FROM documents)) GROUP BY lang""",
    "label_rates": "SELECT lang, count(*) AS n, count(quality) AS labelled, round(coalesce(sum(toxic), 0) / nullif(CAST(count(quality) AS DOUBLE), 0), 6) AS toxic_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "incremental_changes": "SELECT CASE WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'new' END AS input_change, count(*) AS n FROM documents GROUP BY 1",
}
