"""Sampling designs, resamples, alignments and summaries over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import authors, clusters, designs, graph, routing
from quern.plans.studies import _P_SQL, _p
from quern.session import table

_REPETITIONS = 200


def _documents(spark, sf_dir, *columns):
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


def _scored(spark, sf_dir):
    """Labelled documents with their source as component, a score and a second model's score."""
    return _documents(spark, sf_dir, "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("p", _p()).withColumn("q", 1 - F.col("p") * 0.7)


def blind_audit(spark, sf_dir):
    """150 documents of each automatic tail as blind tasks."""
    routed = _documents(spark, sf_dir).select("doc_id", routing.route(_p(), 0.31, 0.96).alias("action"))
    return designs.two_tail_audit(routed, "action", ("auto_keep", "auto_exclude"), "doc_id", "audit-1", 150)


def author_sample(spark, sf_dir):
    """15 authors with a rich history, 5 at its boundary and 5 of the rest, in turn over platforms."""
    events = table(spark, sf_dir, "events")
    rolled = authors.roll_up(events, "event_type", "user_id", F.to_date("ts"), F.col("value") > 95)
    rows = rolled.select("platform_key", F.concat_ws(":", "platform_key", F.col("author_id").cast("string")).alias("author"), authors.author_stratum(F.col("distinct_days"), F.col("span_days"), F.col("has_profile")).alias("stratum"))
    return designs.bucketed_sample(rows, "stratum", (("HISTORY_RICH", 15), ("BOUNDARY", 5)), "platform_key", "author", "pilot", 25)


def length_sample(spark, sf_dir):
    return designs.length_sample(_documents(spark, sf_dir, "n_chars"), routing.length_band(F.col("n_chars")), "n_chars", "doc_id", "dev", 10)


def bundle_audit(spark, sf_dir):
    """100 documents by hash of those without a label."""
    return designs.audit_outside(_documents(spark, sf_dir, "lang"), table(spark, sf_dir, "labels"), "doc_id", "bundle", 100)


def bootstrap_multiplicities(spark, sf_dir):
    return designs.multiplicities(_scored(spark, sf_dir), "source", "boot", _REPETITIONS)


def bootstrap_ratios(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    found = designs.bootstrap_ratios(rows, "source", F.col("toxic"), F.lit(1), designs.multiplicities(rows, "source", "boot", _REPETITIONS))
    return found.select("rep", F.round("ratio", 6).alias("ratio"))


def paired_deltas(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    found = designs.paired_deltas(rows, "source", "toxic", "p", "q", designs.multiplicities(rows, "source", "boot", _REPETITIONS))
    return found.select("rep", F.round("log_loss_delta", 6).alias("log_loss_delta"), F.round("error_delta", 6).alias("error_delta"))


def coder_bootstrap(spark, sf_dir):
    """Agreement of the two label columns, as of two coders, with sources resampled."""
    rows = _scored(spark, sf_dir)
    found = designs.alpha_resamples(rows, "source", "quality", "toxic", (0, 1), designs.multiplicities(rows, "source", "boot", _REPETITIONS))
    return found.select("rep", F.round("alpha", 6).alias("alpha"))


def coverage_thresholds(spark, sf_dir):
    """The lowest score that 90, 80 and 50 % of the documents reach, and how many lie above the threshold just below it."""
    rows = _documents(spark, sf_dir).select(_p().alias("p"))
    cuts = [(c, designs.coverage_threshold(rows, "p", c)) for c in (0.9, 0.8, 0.5)]
    counts = rows.agg(*[F.sum((F.col("p") > t).cast("bigint")).alias(f"n{k}") for k, (_, t) in enumerate(cuts)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.round(F.lit(t), 6).alias("threshold"), F.col(f"n{k}").alias("above_n")) for k, (c, t) in enumerate(cuts)]))
    return counts.select(each.alias("x")).select("x.*")


def row_alignment(spark, sf_dir):
    """Documents against a revision of them: every seventh is gone, every eleventh has lost its language."""
    docs = _documents(spark, sf_dir, "lang", "source", "n_chars")
    revised = docs.where("doc_id % 7 <> 0").withColumn("lang", F.when(F.col("doc_id") % 11 != 0, F.col("lang")))
    return designs.aligned(docs, revised, "doc_id", ("lang", "source", "n_chars")).select("doc_id", "state", F.array_join("changed", ",").alias("changed"))


def exists_guards(spark, sf_dir):
    """Orders without a customer, without lines, or with a line that came back."""
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey")), table(spark, sf_dir, "lineitem")
    guards = [("customer", table(spark, sf_dir, "customer"), ["c_custkey"], True), ("lines", lines, ["l_orderkey"], True), ("returned", lines.where("l_returnflag = 'R'"), ["l_orderkey"], False)]
    return designs.guard_breaches(orders, "o_orderkey", guards)


def task_bijection(spark, sf_dir):
    """Labels against every second document with its id's half repeated."""
    tasks = _documents(spark, sf_dir).where("doc_id % 2 = 0").select((F.col("doc_id") - F.col("doc_id") % 4).alias("doc_id"))
    return designs.bijection_problems(table(spark, sf_dir, "labels").select("doc_id"), tasks, "doc_id")


_GAPS, _FINALS = {"en": 50, "other": 20}, {"en": 500, "other": 200}


def replacement_schedule(spark, sf_dir):
    """Unlabelled documents that fill 50 gaps of one frame and 20 of another, by what each still lacks."""
    queue = _documents(spark, sf_dir, F.when(F.col("lang") == "en", "en").otherwise("other").alias("frame")).join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    from quern.operators.sampling import hash_order

    found = designs.scheduled(queue, "frame", [hash_order("replace", "doc_id"), F.col("doc_id")], _GAPS, _FINALS)
    return found.select("step", "frame", "number", "doc_id")


def blocked_components(spark, sf_dir):
    """Unlabelled documents, and whether a labelled one is in their component of equal texts."""
    docs = _documents(spark, sf_dir, clusters.ascii_key(F.col("text")).alias("key"))
    edges = docs.join(docs.groupBy("key").agg(F.min("doc_id").alias("low")), "key").select(F.col("doc_id").alias("src"), F.col("low").alias("dst"))
    at = graph.connected_components(edges).withColumnRenamed("node", "doc_id")
    return designs.blocked(at, table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "component", "blocked")


def strata_summary(spark, sf_dir):
    docs = _documents(spark, sf_dir, "n_chars", F.size(F.split("text", "\n")).cast("bigint").alias("lines"))
    out = designs.strata_summary(docs, routing.length_band(F.col("n_chars")), "lines")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("median", F.col("median").cast("double"))


def review_summary(spark, sf_dir):
    """The labels as a review of each other, by source; every tenth is unsure."""
    rows = _documents(spark, sf_dir, "source").join(table(spark, sf_dir, "labels"), "doc_id")
    reviewed = F.when(F.col("doc_id") % 10 == 0, "uncertain").otherwise(F.col("toxic").cast("string"))
    return designs.review_summary(rows.select("source", F.col("quality").cast("string").alias("original"), reviewed.alias("reviewed")), "source", "original", "reviewed")


def nearest_share(spark, sf_dir):
    """For each event type the value whose share of events above is nearest to that of views and clicks above theirs."""
    return designs.nearest_share(table(spark, sf_dir, "events"), "event_type", "value", {"view": 40.0, "click": 60.0}, [float(t) for t in range(5, 100, 5)])


def safest_source(spark, sf_dir):
    """Of the sources with at most 12 % toxic documents the one of the least loss, then the most documents, then the name."""
    per = _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("toxic"), 6).alias("toxic_rate"), F.round(F.avg((F.col("p") - F.col("toxic")) ** 2), 6).alias("loss"))
    return designs.safest(per, F.col("toxic_rate") <= 0.12, [F.col("loss"), F.desc("n"), F.col("source")], [F.col("toxic_rate"), F.col("source")])


def line_context(spark, sf_dir):
    return designs.line_context(_documents(spark, sf_dir, "text"), "doc_id", "text")


def metadata_lines(spark, sf_dir):
    """Documents whose first line is made of tags, names and addresses alone."""
    line = F.split("text", "\n")[0]
    return _documents(spark, sf_dir, T.metadata_only(line).alias("metadata_only"), T.metadata_only(F.concat(F.lit("#x @"), F.regexp_replace(line, r"\s", ""))).alias("as_name"))


def props_changes(spark, sf_dir):
    """Events whose properties, against those of the event before, differ in allowed keys alone."""
    events = table(spark, sf_dir, "events")
    earlier = events.select((F.col("event_id") + 1).alias("event_id"), F.col("props").alias("before"))
    both = events.select("event_id", "props").join(earlier, "event_id")
    return both.select("event_id", T.json_change_allowed(F.col("before"), F.col("props"), ("k",)).alias("k_may_change"), T.json_change_allowed(F.col("before"), F.col("props"), ()).alias("nothing_may"))


QUERIES = {f.__name__: f for f in (
    blind_audit, author_sample, length_sample, bundle_audit, bootstrap_multiplicities, bootstrap_ratios, paired_deltas, coder_bootstrap, coverage_thresholds, row_alignment, exists_guards, task_bijection,
    replacement_schedule, blocked_components, strata_summary, review_summary, nearest_share, safest_source, line_context, metadata_lines, props_changes,
)}


def _draw(seed, key="doc_id"):
    return f"sha256('{seed}:' || CAST({key} AS VARCHAR))"


_BAND = "CAST(CASE WHEN n_chars >= 400 THEN 4 WHEN n_chars >= 150 THEN 3 WHEN n_chars >= 60 THEN 2 WHEN n_chars >= 20 THEN 1 ELSE 0 END AS INTEGER)"
_S = f"s AS (SELECT doc_id, source, quality, toxic, p, 1 - p * 0.7 AS q FROM (SELECT doc_id, source, quality, toxic, {_P_SQL} AS p FROM documents JOIN labels USING (doc_id)))"
_BOOT = f"""{_S}, c AS (SELECT source, row_number() OVER (ORDER BY {_draw('component', 'source')}, source) AS number FROM (SELECT DISTINCT source FROM s)), n AS (SELECT count(*) AS n FROM c),
d AS (SELECT rep, CAST('0x' || sha256('boot:' || rep || ':' || i)[1:8] AS BIGINT) % n.n + 1 AS number FROM n, (SELECT unnest(range(200)) AS rep), LATERAL (SELECT unnest(range(n.n)) AS i)),
m AS (SELECT CAST(rep AS INTEGER) AS rep, source, count(*) AS times FROM d JOIN c USING (number) GROUP BY 1, 2)"""
_LOSS = "-(toxic * ln(greatest(least({0}, 1 - 1e-6), 1e-6)) + (1 - toxic) * ln(1 - greatest(least({0}, 1 - 1e-6), 1e-6)))"
_MISSED = "CASE WHEN toxic = 0 AND {0} >= 0.5 THEN 1 ELSE 0 END"

ORACLES = {
    "blind_audit": f"""
WITH r AS (SELECT doc_id, CASE WHEN p <= 0.31 THEN 'auto_keep' WHEN p >= 0.96 THEN 'auto_exclude' ELSE 'manual_review' END AS action FROM (SELECT doc_id, {_P_SQL} AS p FROM documents)),
t AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY {_draw('audit-1')}, doc_id) AS k, count(*) OVER (PARTITION BY action) AS tail_size FROM r WHERE action <> 'manual_review')
SELECT doc_id, action, sha256('audit-1|task|' || doc_id)[1:24] AS task_id, CAST(row_number() OVER (ORDER BY {_draw('audit-1|shuffle')}, doc_id) AS INTEGER) AS position, tail_size FROM t WHERE k <= 150""",
    "author_sample": f"""
WITH a AS (SELECT event_type AS platform_key, event_type || ':' || user_id AS author, count(DISTINCT CAST(ts AS DATE)) >= 3 AND date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) >= 30 AS rich, bool_or(value > 95) AS profile
  FROM events WHERE user_id IS NOT NULL GROUP BY event_type, user_id),
s AS (SELECT platform_key, author, CASE WHEN rich AND profile THEN 'HISTORY_RICH' WHEN rich OR profile THEN 'BOUNDARY' ELSE 'RANDOM_FRAME' END AS stratum FROM a),
t1 AS (SELECT *, row_number() OVER (PARTITION BY stratum, platform_key ORDER BY sha256('pilot:' || stratum || ':' || author), author) AS turn FROM s),
r1 AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, platform_key) AS k FROM t1),
b AS (SELECT platform_key, author, stratum, stratum AS bucket FROM r1 WHERE (stratum = 'HISTORY_RICH' AND k <= 15) OR (stratum = 'BOUNDARY' AND k <= 5)),
t2 AS (SELECT *, row_number() OVER (PARTITION BY platform_key ORDER BY sha256('pilot:RANDOM_REMAINDER:' || author), author) AS turn FROM s WHERE author NOT IN (SELECT author FROM b)),
r2 AS (SELECT *, row_number() OVER (ORDER BY turn, platform_key) AS k FROM t2)
SELECT * FROM b UNION ALL SELECT platform_key, author, stratum, 'RANDOM_REMAINDER' FROM r2 WHERE k <= 25 - (SELECT count(*) FROM b)""",
    "length_sample": f"""
WITH d AS (SELECT doc_id, n_chars, {_BAND} AS bucket FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_draw('dev')}, doc_id) AS k FROM d),
t AS (SELECT doc_id, n_chars, bucket, false AS targeted FROM r WHERE k <= 10), l AS (SELECT doc_id, n_chars, bucket, true AS targeted FROM d ORDER BY n_chars DESC, doc_id LIMIT 1)
SELECT * FROM t UNION ALL SELECT * FROM l WHERE doc_id NOT IN (SELECT doc_id FROM t)""",
    "bundle_audit": f"SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY {_draw('bundle')}, doc_id LIMIT 100",
    "bootstrap_multiplicities": f"WITH {_BOOT} SELECT rep, source, times FROM m",
    "bootstrap_ratios": f"WITH {_BOOT}, g AS (SELECT source, sum(toxic) AS a, count(*) AS b FROM s GROUP BY source) SELECT rep, round(CAST(sum(a * times) AS DOUBLE) / sum(b * times), 6) AS ratio FROM m JOIN g USING (source) GROUP BY rep",
    "paired_deltas": f"""
WITH {_BOOT}, g AS (SELECT source, count(*) AS b, sum(toxic) AS a, sum({_LOSS.format('q')} - ({_LOSS.format('p')})) AS l, sum({_MISSED.format('q')} - {_MISSED.format('p')}) AS e FROM s GROUP BY source)
SELECT rep, round(sum(l * times) / sum(b * times), 6) AS log_loss_delta, round(CAST(sum(e * times) AS DOUBLE) / (sum(b * times) - sum(a * times)), 6) AS error_delta FROM m JOIN g USING (source) GROUP BY rep
HAVING sum(a * times) > 0 AND sum((b - a) * times) > 0""",
    "coder_bootstrap": f"""
WITH {_BOOT}, g AS (SELECT source, count(*) AS b, count(*) FILTER (quality <> toxic) AS e, sum((quality = 0)::INT + (toxic = 0)::INT) AS v0, sum((quality = 1)::INT + (toxic = 1)::INT) AS v1 FROM s GROUP BY source),
t AS (SELECT rep, CAST(sum(b * times) AS DOUBLE) AS n, CAST(sum(e * times) AS DOUBLE) AS e, CAST(sum(v0 * times) AS DOUBLE) AS v0, CAST(sum(v1 * times) AS DOUBLE) AS v1 FROM m JOIN g USING (source) GROUP BY rep),
x AS (SELECT *, 1 - (v0 * (v0 - 1) + v1 * (v1 - 1)) / (2 * n * (2 * n - 1)) AS expected FROM t)
SELECT rep, round(CASE WHEN expected > 0 THEN 1 - (e / n) / expected END, 6) AS alpha FROM x""",
    "coverage_thresholds": f"""
WITH d AS (SELECT {_P_SQL} AS p FROM documents), r AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS k, count(*) OVER () AS n FROM d), c AS (SELECT unnest([0.9, 0.8, 0.5]::DOUBLE[]) AS coverage)
SELECT coverage, round(p, 6) AS threshold, (SELECT count(*) FROM d WHERE d.p >= r.p) AS above_n FROM r JOIN c ON k = CAST(ceil((n - 1) * (1 - coverage)) AS BIGINT)""",
    "row_alignment": """
SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'only_left' WHEN doc_id % 11 = 0 AND lang IS NOT NULL THEN 'changed' ELSE 'same' END AS state,
  CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 AND lang IS NOT NULL THEN 'lang' ELSE '' END AS changed FROM documents""",
    "exists_guards": """
SELECT o_orderkey, 'customer' AS guard FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey)
UNION ALL SELECT o_orderkey, 'lines' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)
UNION ALL SELECT o_orderkey, 'returned' FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')""",
    "task_bijection": """
WITH l AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1), r AS (SELECT doc_id - doc_id % 4 AS doc_id, count(*) AS m FROM documents WHERE doc_id % 2 = 0 GROUP BY 1),
p AS (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN n IS NULL THEN 'missing_left' WHEN m IS NULL THEN 'missing_right' WHEN n > 1 THEN 'repeated_left' WHEN m > 1 THEN 'repeated_right' END AS problem FROM l FULL JOIN r ON l.doc_id = r.doc_id)
SELECT * FROM p WHERE problem IS NOT NULL""",
    "replacement_schedule": f"""
WITH RECURSIVE s AS (SELECT 0 AS step, '' AS frame, 50 AS a, 20 AS b UNION ALL
  SELECT step + 1, CASE WHEN b = 0 OR (a > 0 AND a / 500.0 >= b / 200.0) THEN 'en' ELSE 'other' END, a - (b = 0 OR (a > 0 AND a / 500.0 >= b / 200.0))::INT, b - (NOT (b = 0 OR (a > 0 AND a / 500.0 >= b / 200.0)))::INT FROM s WHERE a + b > 0),
p AS (SELECT step, frame, CAST(CASE WHEN frame = 'en' THEN 50 - a ELSE 20 - b END AS INTEGER) AS number FROM s WHERE step > 0),
q AS (SELECT doc_id, frame, row_number() OVER (PARTITION BY frame ORDER BY {_draw('replace')}, doc_id) AS number FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS frame FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)))
SELECT step, frame, p.number, doc_id FROM p JOIN q USING (frame, number)""",
    "blocked_components": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(lower(text), '\s+', '', 'g')) AS key, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS component, bool_or(labelled) OVER (PARTITION BY key) AS blocked FROM d) SELECT doc_id, component, blocked FROM g WHERE NOT labelled""",
    "strata_summary": f"""
WITH d AS (SELECT {_BAND} AS bucket, len(string_split(text, chr(10))) AS v FROM documents)
SELECT bucket, grouping(bucket) = 1 AS whole, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, min(v) AS least, max(v) AS greatest, round(avg(v), 6) AS mean, CAST(median(v) AS DOUBLE) AS median FROM d GROUP BY GROUPING SETS ((bucket), ())""",
    "review_summary": """
WITH r AS (SELECT source, CASE WHEN doc_id % 10 = 0 THEN 'u' WHEN quality = toxic THEN 'm' ELSE 'c' END AS d FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS n, count(*) FILTER (d = 'm') AS maintained, count(*) FILTER (d = 'c') AS changed, count(*) FILTER (d = 'u') AS uncertain,
  round(CAST(count(*) FILTER (d = 'c') AS DOUBLE) / nullif(count(*) FILTER (d <> 'u'), 0), 6) AS change_rate FROM r GROUP BY source""",
    "nearest_share": """
WITH n AS (SELECT event_type, count(*) AS n, count(*) FILTER (event_type = 'view' AND value >= 40) + count(*) FILTER (event_type = 'click' AND value >= 60) AS a FROM events GROUP BY 1),
s AS (SELECT CAST(sum(a) AS DOUBLE) / sum(n) AS share FROM n WHERE event_type IN ('view', 'click')), g AS (SELECT CAST(unnest(range(5, 100, 5)) AS DOUBLE) AS threshold),
x AS (SELECT event_type, threshold, count(*) FILTER (value >= threshold) AS above_n FROM events, g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(CAST(above_n AS DOUBLE) / n - share), threshold) AS k FROM x JOIN n USING (event_type), s)
SELECT event_type, n, threshold, above_n, round(CAST(above_n AS DOUBLE) / n, 6) AS above_rate FROM r WHERE k = 1""",
    "safest_source": f"""
WITH {_S}, g AS (SELECT source, count(*) AS n, round(avg(toxic), 6) AS toxic_rate, round(avg((p - toxic) ** 2), 6) AS loss FROM s GROUP BY source),
e AS (SELECT *, true AS eligible FROM g WHERE toxic_rate <= 0.12 ORDER BY loss, n DESC, source LIMIT 1), f AS (SELECT *, false AS eligible FROM g ORDER BY toxic_rate, source LIMIT 1)
SELECT * FROM e UNION ALL SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM e)""",
    "line_context": """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), e AS (SELECT doc_id, unnest(range(len(a))) AS i, a FROM l)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, CAST(length(a[i + 1]) AS INTEGER) AS chars, CASE WHEN i > 0 THEN CAST(length(a[i]) AS INTEGER) END AS before, CAST(length(a[i + 2]) AS INTEGER) AS after FROM e""",
    "metadata_lines": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10))[1] AS x FROM documents), t AS (SELECT doc_id, x, '#x @' || regexp_replace(x, '\s', '', 'g') AS y FROM l)
SELECT doc_id, regexp_matches(x, '\S') AND NOT regexp_matches(regexp_replace(x, 'https?://\S+|#[^\s#]+#?|@\S+', '', 'g'), '[\p{L}\p{N}]') AS metadata_only,
  regexp_matches(y, '\S') AND NOT regexp_matches(regexp_replace(y, 'https?://\S+|#[^\s#]+#?|@\S+', '', 'g'), '[\p{L}\p{N}]') AS as_name FROM t""",
    "props_changes": """
SELECT b.event_id, true AS k_may_change, a.props = b.props OR json_extract(a.props, '$.k') = json_extract(b.props, '$.k') AS nothing_may FROM events a JOIN events b ON b.event_id = a.event_id + 1
WHERE a.props IS NOT NULL AND b.props IS NOT NULL""",
}
