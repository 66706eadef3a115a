"""Leakage groups, models, conversations, event windows and literal-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.numeric import normalised
from quern.operators import clusters, graph, models, sampling, segment
from quern.session import cut, table


def leakage_components(spark, sf_dir):
    """Components of documents tied by author (source and language), exact text or a confirmed pair, with a flag for each kind of tie.

    The author here is the source with the id's hundred, so that groups stay small; every thirtieth has none and ties nothing.
    """
    author = F.when(F.col("doc_id") % 30 != 0, F.concat_ws(":", "source", F.floor(F.col("doc_id") / 100).cast("string")))
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", author.alias("author"), F.unhex(clusters.ascii_key(F.col("text"))).alias("exact")))

    def star(key):
        least = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
        return docs.join(least, key).where("n > 1").select(F.col("doc_id").alias("src"), F.col("low").alias("dst"), F.lit(key).alias("kind"))

    confirmed = docs.where("doc_id % 97 = 5").select(F.col("doc_id").alias("src"), (F.col("doc_id") - 5).alias("dst"), F.lit("near").alias("kind"))
    edges = cut(star("author").unionByName(star("exact")).unionByName(confirmed))
    at = graph.connected_components(edges)
    kinds = edges.join(at, edges.src == at.node).groupBy("component").agg(*[F.max(F.col("kind") == k).alias(f"has_{k}") for k in ("author", "exact", "near")])
    whole = docs.select("doc_id").join(at, docs.doc_id == at.node, "left").withColumn("component", F.coalesce("component", "doc_id"))
    no = F.lit(False)
    return whole.join(kinds, "component", "left").select("doc_id", "component", *[F.coalesce(f"has_{k}", no).alias(f"has_{k}") for k in ("author", "exact", "near")])


def svm_margin_oof(spark, sf_dir):
    """Out-of-fold margins of the linear model for low quality, folds by hash of the source."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", F.lower("text").alias("text"), (1 - F.col("quality")).alias("label"))
    plan = models.SparsePlan(width=2, features=1 << 12, iterations=10, folds=3)
    folded = sampling.hash_folds(rows, "source", plan.folds, "oof")
    return models.out_of_fold(folded, "doc_id", "text", "label", "fold", plan)


def sigmoid_calibration(spark, sf_dir):
    """Calibrated probabilities from the out-of-fold margins."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("label"))
    oof = cut(svm_margin_oof(spark, sf_dir).join(labels, "doc_id"))
    fitted = models.calibrate(oof, "margin", "label")
    return oof.select("doc_id", fitted.column("margin").alias("p_unrelated"))


def conversation_cohesion(spark, sf_dir):
    """Cohesion and depth at each turn gap of a conversation, from hashed word vectors; a conversation is one array."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for conv, turns_ in zip(frame["conv_id"], frame["t"]):
                texts = [x["text"] or "" for x in turns_]
                c = segment.cohesion([max(1, segment.count_tokens(x)) for x in texts], segment.hashed_vectors(texts), 400)
                d = segment.depths(c)
                out += [(conv, k, float(c[k]), float(d[k])) for k in range(len(c))]
            yield pd.DataFrame(out, columns=["conv_id", "gap", "cohesion", "depth"])

    from quern.session import ready_python

    ready_python(spark)
    return turns.mapInPandas(run, "conv_id bigint, gap bigint, cohesion double, depth double")


def turn_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.countDistinct("role").alias("roles"), F.max(F.length("text")).cast("bigint").alias("longest"))


def event_hours(spark, sf_dir):
    """Tumbling hours of events by type: the batch form of the streaming window."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "events")


def vector_norms(spark, sf_dir):
    """Vectors that pass validation (every seventh is spoilt: zero, or with one component missing), and what normalisation makes of them."""
    spoilt = F.when(F.col("vec_id") % 14 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 14 == 7, F.transform("embedding", lambda x, i: F.when(i != 3, x))).otherwise(F.col("embedding"))
    items = table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("dimension"), normalised(spoilt).alias("v"))
    return items.select("vec_id", "dimension", F.col("v").isNotNull().alias("valid"), F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(1)), 5).alias("second"))


def mention_and_url_tokens(spark, sf_dir):
    """Every text, in a line with an address, a topic and a mention, after the chain's steps that need no NFKC; blanks around a topic are not counted."""
    body = F.concat(F.lit("see https://a.example/x?y=1, "), F.col("source"), F.lit(" #"), F.col("lang"), F.lit("# @user_"), F.col("doc_id").cast("string"), F.lit(" end\n"), F.coalesce("text", F.lit("")))
    clean = T.normalise_ascii(body, outer_blanks=False)
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("c")).select("doc_id", F.substring_index("c", "\n", 1).alias("first_line"), F.length("c").cast("bigint").alias("chars"), F.sha2(F.col("c").cast("binary"), 256).alias("sha"))


QUERIES = {f.__name__: f for f in (leakage_components, svm_margin_oof, sigmoid_calibration, conversation_cohesion, turn_counts, event_hours, vector_norms, mention_and_url_tokens)}

ORACLES = {
    "leakage_components": """
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN doc_id % 30 <> 0 THEN source || ':' || CAST(floor(doc_id / 100) AS BIGINT) END AS author, sha256(regexp_replace(lower(text), '\\s+', '', 'g')) AS exact FROM documents),
star AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY author) AS b, count(*) OVER (PARTITION BY author) AS n, 'author' AS kind FROM d WHERE author IS NOT NULL
  UNION ALL SELECT doc_id, min(doc_id) OVER (PARTITION BY exact), count(*) OVER (PARTITION BY exact), 'exact' FROM d UNION ALL SELECT doc_id, doc_id - 5, 2, 'near' FROM d WHERE doc_id % 97 = 5),
tie AS (SELECT * FROM star WHERE n > 1), edge AS (SELECT DISTINCT a, b FROM tie WHERE a <> b UNION SELECT DISTINCT b, a FROM tie WHERE a <> b),
reach AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT edge.b, reach.c FROM reach JOIN edge ON reach.a = edge.a), comp AS (SELECT a AS doc_id, min(c) AS component FROM reach GROUP BY a),
kinds AS (SELECT component, bool_or(kind = 'author') AS has_author, bool_or(kind = 'exact') AS has_exact, bool_or(kind = 'near') AS has_near FROM tie JOIN comp ON tie.a = comp.doc_id GROUP BY component)
SELECT doc_id, component, coalesce(has_author, false) AS has_author, coalesce(has_exact, false) AS has_exact, coalesce(has_near, false) AS has_near FROM comp LEFT JOIN kinds USING (component)""",
    "turn_counts": "SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, CAST(max(length(text)) AS BIGINT) AS longest FROM conversations GROUP BY conv_id",
    "event_hours": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS events FROM events GROUP BY 1, 2",
    "vector_norms": """
WITH v AS (SELECT vec_id, len(embedding) AS n, vec_id % 7 <> 0 AS valid, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, CAST(n AS INTEGER) AS dimension, valid, CASE WHEN valid THEN round(e[1] / sqrt(list_inner_product(e, e)), 5) END AS first, CASE WHEN valid THEN round(e[2] / sqrt(list_inner_product(e, e)), 5) END AS second FROM v""",
    "mention_and_url_tokens": r"""
WITH b AS (SELECT doc_id, 'see https://a.example/x?y=1, ' || source || ' #' || lang || '# @user_' || doc_id || ' end' || chr(10) || coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\r\n|\r', chr(10), 'g'), '(?i)(?:https?://|www\.)[^\s<>\[\]{}（）()，。！？；：、“”‘’,!;@]*[^\s<>\[\]{}（）()，。！？；：、“”‘’,!;@.:]', '[URL]', 'g') AS t FROM b),
h AS (SELECT doc_id, regexp_replace(t, '#[ \t]*([^#\n]{1,100}?)[ \t]*#', '[TOPIC]\1[/TOPIC]', 'g') AS t FROM u),
m AS (SELECT doc_id, regexp_replace(t, '(^|[^\p{L}\p{N}_.+-])@[\p{L}\p{N}_·.-]*[\p{L}\p{N}_·]', '\1[MENTION]', 'g') AS t FROM h),
w AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM m), c AS (SELECT doc_id, trim(t, ' ' || chr(10)) AS c FROM w)
SELECT doc_id, string_split(c, chr(10))[1] AS first_line, CAST(length(c) AS BIGINT) AS chars, sha256(c) AS sha FROM c""",
}
