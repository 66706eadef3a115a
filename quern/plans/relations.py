"""Relational parity: closures, probes, merges, versions, set differences over the star schema and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import lineage, relational
from quern.session import table


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def snapshot_closure(spark, sf_dir):
    """Row counts of a filtered snapshot: urgent orders, their customers and their lines."""
    parts = relational.snapshot_closure(
        _orders(spark, sf_dir), F.col("o_orderpriority") == "1-URGENT", {"parents": (table(spark, sf_dir, "customer"), "o_custkey", "c_custkey")}, {"children": (table(spark, sf_dir, "lineitem"), "l_orderkey", "o_orderkey")}, "o_orderkey"
    )
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def left_probe(spark, sf_dir):
    """Documents against their upper half with one source changed: missing and mismatching rows."""
    docs = table(spark, sf_dir, "documents")
    other = docs.where("doc_id % 7 <> 0").withColumn("source", F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("source")))
    return relational.left_probe(docs, other, "doc_id", "source")


def current_leaf(spark, sf_dir):
    """Orders that no later order of the customer supersedes; the previous order is the one superseded."""
    from pyspark.sql import Window

    prev = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    chain = _orders(spark, sf_dir).select("o_orderkey", "o_custkey", prev.alias("supersedes"))
    return relational.current_leaves(chain, "o_orderkey", "supersedes").select("o_orderkey", "o_custkey")


def child_counts(spark, sf_dir):
    """Orders whose declared number of lines (here the key modulo 7) is not the actual one."""
    parents = _orders(spark, sf_dir).select("o_orderkey", (F.col("o_orderkey") % 7).alias("declared"))
    return relational.child_count_mismatches(parents, table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "declared")


def paired_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    left = docs.select("doc_id", (F.col("n_chars") % 100).alias("v"))
    right = docs.where("doc_id % 2 = 0").select("doc_id", (F.length("text") % 97).cast("bigint").alias("v"))
    return relational.paired(left, right, "doc_id", "v")


def set_diff_both_ways(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    left = rows.where("l_quantity <= 30").select("l_partkey", "l_suppkey")
    right = rows.where("l_quantity >= 20").select("l_partkey", "l_suppkey")
    return relational.symmetric_difference(left, right)


def priority_merge(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    gold = labels.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("exclude").alias("v"))
    audit = labels.where("doc_id % 3 = 1").select("doc_id", F.when(F.col("toxic") == 1, "exclude").otherwise("keep").alias("v"))
    merged = relational.priority_merge(docs, "doc_id", [("training", gold, "v"), ("audit", audit, "v")], F.when(F.col("n_chars") > 1000, "keep").otherwise("manual_review"))
    return merged.select("doc_id", "final", "origin")


def merge_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    scored = docs.where("doc_id % 5 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, "other").otherwise(F.col("sha")).alias("sha")).unionByName(docs.where("doc_id % 50 = 1")).unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), "sha").where("doc_id > -4"))
    return relational.merge_exactly_once(docs, scored, "doc_id", "sha")


def versioned_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    old = docs.where("doc_id % 4 <> 0").withColumn("lang", F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("lang")))
    history = old.withColumn("version", F.lit(1).cast("bigint")).unionByName(old.where("doc_id % 6 = 1").withColumn("version", F.lit(2).cast("bigint")))
    return relational.versioned(docs, history, "doc_id", ["source", "lang"], "version").select("doc_id", "input_change", "version")


def union_disjoint(spark, sf_dir):
    """Rows of three evidence sets, and how many keys more than one has."""
    labels = table(spark, sf_dir, "labels").select("doc_id")
    parts, twice = relational.union_disjoint([("a", labels.where("doc_id % 3 = 0")), ("b", labels.where("doc_id % 3 = 1")), ("c", labels.where("doc_id % 3 = 2 or doc_id % 30 = 0"))], "doc_id")
    return parts.groupBy("origin").agg(F.count(F.lit(1)).alias("n")).unionByName(twice.agg(F.count(F.lit(1)).alias("n")).select(F.lit("repeated").alias("origin"), "n"))


def eligible_population(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return relational.eligible(docs, docs.where("doc_id % 40 = 3"), "source")


def post_exclusion(spark, sf_dir):
    """Dangling references after customers are excluded."""
    out = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey")
    return relational.dangling({"orders": (_orders(spark, sf_dir), "o_custkey"), "kept_orders": (relational.exclude(_orders(spark, sf_dir), out.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"), "o_custkey")}, out, "c_custkey")


def nearest_controls(spark, sf_dir):
    """For each toxic document the nearest in length of the same language that isn't, in its length band first."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "n_chars", F.floor(F.col("n_chars") / 500).alias("band"), "toxic")
    return relational.nearest_controls(docs.where("toxic = 1"), docs.where("toxic = 0"), ["lang"], "band", "n_chars", "doc_id").select("case_id", "control_id", F.col("length_gap").cast("bigint").alias("length_gap"), "exact_band")


def identity_update(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.col("source").cast("binary"), 256).alias("h"))
    new = docs.select("h", "source").distinct().where("source like 'src1%'").select("h", F.concat(F.lit("new_"), "source").alias("source"))
    return relational.conditional_update(docs, new, "h", ["source"]).groupBy("source", "update_state").agg(F.count(F.lit(1)).alias("n"))


def version_max(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("latest"), F.count(F.lit(1)).alias("n"))


def three_way_join(spark, sf_dir):
    o, c, n = _orders(spark, sf_dir), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("c_custkey").alias("customers"))


def row_digest(spark, sf_dir):
    """One digest of each source's rows that doesn't depend on their order."""
    docs = table(spark, sf_dir, "documents").select("source", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "lang", "text").cast("binary"), 256).alias("h"))
    part = F.conv(F.substring("h", 1, 12), 16, 10).cast("bigint")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("digest"))


def contract_violations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = {"lang": F.col("lang").isin("en", "de", "fr"), "length": F.length("text") == F.col("n_chars"), "source": F.col("source").rlike("^src[0-9]$")}
    return lineage.violations(docs, "doc_id", rules).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def rolling_chain(spark, sf_dir):
    """Hash chains over batches of 100 documents."""
    docs = table(spark, sf_dir, "documents").withColumn("batch", F.floor(F.col("doc_id") / 100))
    return lineage.hash_chain(docs, "batch", "doc_id", F.sha2(F.col("text").cast("binary"), 256))


QUERIES = {f.__name__: f for f in (
    snapshot_closure, left_probe, current_leaf, child_counts, paired_join, set_diff_both_ways, priority_merge, merge_candidates, versioned_upsert, union_disjoint, eligible_population,
    post_exclusion, nearest_controls, identity_update, version_max, three_way_join, row_digest, contract_violations, rolling_chain,
)}

ORACLES = {
    "snapshot_closure": """
WITH p AS (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT 'posts' AS table_name, count(*) AS n FROM p UNION ALL SELECT 'parents', count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM p)
UNION ALL SELECT 'children', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM p)""",
    "left_probe": """
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE source END AS source FROM documents WHERE doc_id % 7 <> 0)
SELECT count(*) FILTER (r.doc_id IS NULL) AS missing, count(*) FILTER (r.doc_id IS NOT NULL AND d.source IS DISTINCT FROM r.source) AS mismatched, count(*) AS total FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "current_leaf": "SELECT max(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey",
    "child_counts": """
SELECT o.o_orderkey, o.o_orderkey % 7 AS declared, coalesce(n, 0) AS actual FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON o.o_orderkey = c.l_orderkey
WHERE o.o_orderkey % 7 <> coalesce(n, 0)""",
    "paired_join": "SELECT doc_id, n_chars % 100 AS left_value, CAST(length(text) % 97 AS BIGINT) AS right_value FROM documents WHERE doc_id % 2 = 0",
    "set_diff_both_ways": """
WITH l AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity <= 30), r AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity >= 20)
SELECT *, 'left' AS side FROM (FROM l EXCEPT ALL FROM r) UNION ALL SELECT *, 'right' FROM (FROM r EXCEPT ALL FROM l)""",
    "priority_merge": """
SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 = 0 THEN CASE WHEN quality = 1 THEN 'keep' ELSE 'exclude' END WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 = 1 THEN CASE WHEN toxic = 1 THEN 'exclude' ELSE 'keep' END
  WHEN n_chars > 1000 THEN 'keep' ELSE 'manual_review' END AS final, CASE WHEN l.doc_id IS NULL OR d.doc_id % 3 = 2 THEN 'model' WHEN d.doc_id % 3 = 0 THEN 'training' ELSE 'audit' END AS origin
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "merge_candidates": """
WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents),
s AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'other' ELSE sha END AS sha FROM d WHERE doc_id % 5 <> 0 UNION ALL SELECT * FROM d WHERE doc_id % 50 = 1 UNION ALL SELECT -doc_id - 1, sha FROM d WHERE -doc_id - 1 > -4),
a AS (SELECT doc_id, count(*) AS n, min(sha) AS sha FROM d GROUP BY 1), b AS (SELECT doc_id, count(*) AS n, min(sha) AS sha FROM s GROUP BY 1)
SELECT count(*) FILTER (b.n IS NULL) AS missing, count(*) FILTER (a.n IS NULL) AS unexpected, count(*) FILTER (a.n > 1 OR b.n > 1) AS duplicated, count(*) FILTER (a.sha <> b.sha) AS mismatched FROM a FULL JOIN b ON a.doc_id = b.doc_id""",
    "versioned_upsert": """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN doc_id % 9 = 0 THEN 'changed' ELSE 'unchanged' END AS input_change,
  CAST(CASE WHEN doc_id % 4 = 0 THEN 1 ELSE CASE WHEN doc_id % 6 = 1 THEN 2 ELSE 1 END + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END END AS BIGINT) AS version FROM documents""",
    "union_disjoint": """
SELECT 'a' AS origin, count(*) AS n FROM labels WHERE doc_id % 3 = 0 UNION ALL SELECT 'b', count(*) FROM labels WHERE doc_id % 3 = 1 UNION ALL SELECT 'c', count(*) FROM labels WHERE doc_id % 3 = 2 OR doc_id % 30 = 0
UNION ALL SELECT 'repeated', count(*) FROM labels WHERE doc_id % 30 = 0""",
    "eligible_population": "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 40 = 3)",
    "post_exclusion": "SELECT 'orders' AS table_name, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) UNION ALL SELECT 'kept_orders', 0",
    "nearest_controls": """
WITH d AS (SELECT doc_id, lang, n_chars, CAST(floor(n_chars / 500) AS BIGINT) AS band, toxic FROM documents JOIN labels USING (doc_id)),
m AS (SELECT a.doc_id AS case_id, b.doc_id AS control_id, abs(a.n_chars - b.n_chars) AS gap, a.n_chars AS an, b.n_chars AS bn, a.band = b.band AS same FROM d a JOIN d b ON a.lang = b.lang AND a.toxic = 1 AND b.toxic = 0)
SELECT case_id, control_id, gap AS length_gap, same AS exact_band FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY same DESC, gap, control_id) AS r FROM m) WHERE r = 1""",
    "identity_update": """
SELECT CASE WHEN source LIKE 'src1%' THEN 'new_' || source ELSE source END AS source, CASE WHEN source LIKE 'src1%' THEN 'replaced' ELSE 'absent' END AS update_state, count(*) AS n FROM documents GROUP BY 1, 2""",
    "version_max": "SELECT l_orderkey, max(l_linenumber) AS latest, count(*) AS n FROM lineitem GROUP BY 1",
    "three_way_join": "SELECT n_name, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "row_digest": "SELECT source, count(*) AS n, CAST(sum(CAST('0x' || sha256(concat_ws('|', CAST(doc_id AS VARCHAR), lang, text))[1:12] AS BIGINT)) AS BIGINT) AS digest FROM documents GROUP BY 1",
    "contract_violations": """
SELECT doc_id, reasons FROM (SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' END, CASE WHEN length(text) <> n_chars THEN 'length' END, CASE WHEN NOT regexp_matches(source, '^src[0-9]$') THEN 'source' END) AS reasons FROM documents)
WHERE reasons <> ''""",
    "rolling_chain": """
WITH RECURSIVE d AS (SELECT CAST(floor(doc_id / 100) AS BIGINT) AS batch, sha256(text) AS h, row_number() OVER (PARTITION BY floor(doc_id / 100) ORDER BY doc_id) AS k FROM documents),
c AS (SELECT batch, CAST(0 AS BIGINT) AS k, '' AS chain FROM (SELECT DISTINCT batch FROM d) UNION ALL SELECT d.batch, d.k, sha256(c.chain || '|' || d.h) FROM c JOIN d ON c.batch = d.batch AND d.k = c.k + 1)
SELECT batch, max(k) AS records, max_by(chain, k) AS chain FROM c GROUP BY batch""",
}
