"""Exact clusters, text expressions and near pairs over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import clusters, graph, similarity
from quern.operators.routing import length_band
from quern.session import ready_python, table

_KEY = "sha256(regexp_replace(lower(text), '\\s+', '', 'g'))"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def exact_clusters(spark, sf_dir):
    """Clusters by the exact key of posts without a title."""
    return clusters.exact_clusters(_docs(spark, sf_dir), T.exact_key(F.lit(None).cast("string"), F.col("text")), "doc_id", "source")


def cluster_members_ranked(spark, sf_dir):
    return clusters.members(_docs(spark, sf_dir), clusters.ascii_key(F.col("text")), "doc_id", "source").withColumnRenamed("id", "doc_id")


def cluster_label_conflict(spark, sf_dir):
    docs, labels = _docs(spark, sf_dir).select("doc_id", clusters.ascii_key(F.col("text")).alias("cluster_key")), table(spark, sf_dir, "labels")
    marked = docs.join(labels, "doc_id")
    per = marked.groupBy("cluster_key").agg(F.countDistinct("quality").alias("labels"), F.count(F.lit(1)).alias("labelled"))
    return marked.join(per, "cluster_key").select("doc_id", "cluster_key", "quality", "labelled", (F.col("labels") > 1).alias("conflict"))


def complete_representative(spark, sf_dir):
    """The most complete member of each cluster (longest text), ties to the least id: one aggregate, no window."""
    docs = _docs(spark, sf_dir).select("doc_id", "n_chars", clusters.ascii_key(F.col("text")).alias("cluster_key"))
    best = docs.groupBy("cluster_key").agg(F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id")).alias("b"))
    return best.select("cluster_key", F.col("b.doc_id").alias("representative"), (-F.col("b.n")).alias("completeness"))


def normalised_lengths(spark, sf_dir):
    flat = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\r\n]+", " "))
    return _docs(spark, sf_dir).select("doc_id", F.length("text").cast("bigint").alias("raw_chars"), F.length(flat).cast("bigint").alias("flat_chars"), F.sha2(flat.cast("binary"), 256).alias("flat_sha"))


def normalised_text(spark, sf_dir):
    """The whole normalisation chain (NFKC, emoji by grapheme)."""
    ready_python(spark)
    clean = T.normalise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(clean.cast("binary"), 256).alias("model_sha"), T.exact_key(F.lit(None).cast("string"), F.col("text")).alias("exact_key"), F.length(clean).cast("bigint").alias("model_chars"))


def topic_mention_counts(spark, sf_dir):
    """How many addresses, topics and mentions the steps of the chain replace in each text, in their order."""
    count = lambda x, token: F.regexp_count(x, F.lit(token)).cast("bigint")
    urls = T.replace_urls(T.unify_newlines(F.col("text")), "\x01")
    topics = T.replace_topics(urls, T.Tokens(topic_open="\x02", topic_close="\x03"))
    rows = _docs(spark, sf_dir).select("doc_id", topics.alias("t")).select("doc_id", "t", T.replace_mentions(F.col("t"), "\x04").alias("m"))
    return rows.select("doc_id", count("t", "\x01").alias("urls"), count("t", "\x02").alias("topics"), count("m", "\x04").alias("mentions"))


def _gate():
    """The gate of a post without a title; a source stands in for the status that documents don't have."""
    status = F.when(F.col("source") == "src1", "deleted").when(F.col("source") == "src2", "partial").otherwise("success")
    return T.structure_status(F.lit(None).cast("string"), F.col("text"), status)


def structure_gate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _gate().alias("g")).select("doc_id", F.col("g.status").alias("structure_status"), F.col("g.reason").alias("structure_reason_code"))


def structure_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select(_gate().alias("g")).groupBy(F.col("g.status").alias("structure_status")).agg(F.count(F.lit(1)).alias("n"))


def normalised_posts(spark, sf_dir):
    """Every post as one struct of the whole chain: projection, normalisation, gate, keys."""
    ready_python(spark)
    post = T.normalise_post(F.lit(None).cast("string"), F.col("text"), F.lit("success"))
    return _docs(spark, sf_dir).select("doc_id", F.inline(F.array(post))).select("doc_id", "normalized_sha256", "exact_canonical_sha256", "structure_status", "structure_reason_code", "title_length", "body_length")


def length_bands(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(length_band(F.length("text")).alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"))


def sentence_counts(spark, sf_dir):
    pieces = T.sentences(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", pieces.alias("p")).select("doc_id", F.size("p").cast("bigint").alias("pieces"), F.array_max(F.transform("p", lambda x: F.length(x))).alias("longest"))


def author_pseudonyms(spark, sf_dir):
    """Keyed pseudonyms and masked names of sources."""
    return _docs(spark, sf_dir).select("source").distinct().select("source", T.hmac_sha256("key", F.col("source")).alias("pseudonym"), T.masked(F.col("source")).alias("shown"), F.sha2(F.col("source").cast("binary"), 256).alias("digest"))


def source_digests(spark, sf_dir):
    return _docs(spark, sf_dir).select("source").distinct().select("source", T.masked(F.col("source")).alias("shown"), F.sha2(F.col("source").cast("binary"), 256).alias("digest"))


_RULES = similarity.Blocking(low=4, high=4)


def gram_df(spark, sf_dir):
    """Document frequency of the benchmark's 4-grams."""
    return similarity.gram_df(similarity.grams(table(spark, sf_dir, "benchmark"), "item_id", "text", 4, 4))


def blocking_keys(spark, sf_dir):
    return similarity.blocking_keys(table(spark, sf_dir, "benchmark"), "item_id", "text", _RULES).withColumnRenamed("id", "item_id")


def candidate_pairs(spark, sf_dir):
    return similarity.candidate_pairs(similarity.blocking_keys(table(spark, sf_dir, "benchmark"), "item_id", "text", _RULES))


def near_pairs(spark, sf_dir):
    """Near pairs between the representatives of exact clusters."""
    docs = similarity.representatives(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", clusters.ascii_key(F.col("text")))
    return similarity.near_pairs(docs, "doc_id", "text", 0.8)


def near_components(spark, sf_dir):
    """Components of documents that share an exact key, or a first line of at least 30 characters."""
    docs = _docs(spark, sf_dir)
    first = F.split("text", "\n")[0]
    keys = docs.select("doc_id", F.explode(F.array(F.concat(F.lit("k"), clusters.ascii_key(F.col("text"))), F.when(F.length(first) >= 30, F.concat(F.lit("f"), first)))).alias("key")).where("key is not null")
    least = keys.groupBy("key").agg(F.min("doc_id").alias("low"))
    edges = keys.join(least, "key").select(F.col("doc_id").alias("src"), F.col("low").alias("dst"))
    found = graph.connected_components(edges)
    return docs.select("doc_id").join(found, docs.doc_id == found.node, "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


def word_log_ratio(spark, sf_dir):
    """Smoothed log ratio of word counts in toxic against other labelled documents."""
    docs = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    words = docs.select("toxic", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("term")).groupBy("term", "toxic").agg(F.count(F.lit(1)).alias("tf"))
    return similarity.term_log_ratio(words, F.col("toxic") == 1).select("term", F.round("log_ratio", 6).alias("log_ratio"))


QUERIES = {f.__name__: f for f in (
    exact_clusters, cluster_members_ranked, cluster_label_conflict, complete_representative, normalised_lengths, normalised_text, normalised_posts, topic_mention_counts, structure_gate, structure_counts, length_bands,
    sentence_counts, author_pseudonyms, source_digests, gram_df, blocking_keys, candidate_pairs, near_pairs, near_components, word_log_ratio,
)}

_GRAMS = """grams AS (SELECT DISTINCT item_id, line[i : i + 3] AS gram FROM (SELECT item_id, line, unnest(range(1, length(line) - 2)) AS i
  FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(line) >= 4)),
n AS (SELECT count(*) AS n FROM benchmark)"""
_KEYS = f"""{_GRAMS}, df AS (SELECT gram, count(*) AS df FROM grams GROUP BY gram),
keys AS (SELECT item_id, gram, df FROM (SELECT item_id, gram, df, row_number() OVER (PARTITION BY item_id ORDER BY df, length(gram) DESC, gram) AS r FROM grams JOIN df USING (gram), n
  WHERE df BETWEEN 2 AND greatest(2, least(200, CAST(floor(n.n * 0.05) AS BIGINT)))) WHERE r <= 12)"""

#: NFKC and case folding, as far as letters of the four languages of the table need them.
_EXACT = "sha256('T:' || chr(31) || 'B:' || regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '\\s+', '', 'g'))"
_GATE = r"""CASE WHEN coalesce(text, '') = '' THEN 'invalid empty_title_and_body' WHEN source = 'src1' THEN 'invalid invalid_source_status'
  WHEN regexp_full_match(text, '请先登录|登录后查看|登录即可查看') THEN 'invalid login_wall' WHEN regexp_full_match(text, '抓取失败|加载失败|网络错误|页面出错') THEN 'invalid capture_error'
  WHEN regexp_full_match(text, '内容不存在|内容已删除|帖子不存在|该内容无法查看') THEN 'invalid content_unavailable' WHEN regexp_full_match(text, '暂无内容|暂无正文|无正文|加载中[.。…]*') THEN 'invalid placeholder_text'
  WHEN source = 'src2' THEN 'uncertain uncertain_source_status' WHEN regexp_full_match(text, '(?:\[(?:URL|MENTION|EMOJI)\]|\s)+') THEN 'uncertain replacement_tokens_only' ELSE 'usable structure_usable' END"""

ORACLES = {
    "exact_clusters": f"SELECT {_EXACT} AS cluster_key, count(*) AS cluster_size, min(doc_id) AS representative, min(source) <> max(source) AS cross_platform FROM documents GROUP BY 1",
    "cluster_members_ranked": f"""
WITH d AS (SELECT doc_id, {_KEY} AS cluster_key FROM documents)
SELECT doc_id, cluster_key, count(*) OVER w AS cluster_size, min(doc_id) OVER w AS representative, doc_id = min(doc_id) OVER w AS is_representative FROM d WINDOW w AS (PARTITION BY cluster_key)""",
    "cluster_label_conflict": f"""
WITH d AS (SELECT doc_id, {_KEY} AS cluster_key, quality FROM documents JOIN labels USING (doc_id)),
p AS (SELECT cluster_key, count(DISTINCT quality) AS labels, count(*) AS labelled FROM d GROUP BY 1)
SELECT doc_id, cluster_key, quality, labelled, labels > 1 AS conflict FROM d JOIN p USING (cluster_key)""",
    "complete_representative": f"""
SELECT cluster_key, doc_id AS representative, n_chars AS completeness FROM (
  SELECT doc_id, n_chars, {_KEY} AS cluster_key, row_number() OVER (PARTITION BY {_KEY} ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""",
    "normalised_lengths": r"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS raw_chars, CAST(length(f) AS BIGINT) AS flat_chars, sha256(f) AS flat_sha
FROM (SELECT doc_id, text, trim(regexp_replace(lower(text), '[ \t\r\n]+', ' ', 'g')) AS f FROM documents)""",
    "topic_mention_counts": r"""
WITH u AS (SELECT doc_id, regexp_replace(text, '(?i)(?:https?://|www\.)[^\s<>\[\]{}（）()，。！？；：、“”‘’,!;@]+', chr(1), 'g') AS t FROM documents),
h AS (SELECT doc_id, t, regexp_replace(t, '#[^#\n]{1,100}#', chr(2) || ' ', 'g') AS m FROM u)
SELECT doc_id, CAST(len(regexp_extract_all(t, '\x01')) AS BIGINT) AS urls, CAST(len(regexp_extract_all(m, '\x02')) AS BIGINT) AS topics,
  CAST(len(regexp_extract_all(m, '(?:^|[^\p{L}\p{N}_.+-])@[\p{L}\p{N}_·.-]+')) AS BIGINT) AS mentions FROM h""",
    "structure_gate": f"SELECT doc_id, split_part({_GATE}, ' ', 1) AS structure_status, split_part({_GATE}, ' ', 2) AS structure_reason_code FROM documents",
    "structure_counts": f"SELECT split_part({_GATE}, ' ', 1) AS structure_status, count(*) AS n FROM documents GROUP BY 1",
    "author_pseudonyms": """
WITH k AS (SELECT rpad(hex('key'::BLOB), 128, '0') AS k), p AS (
  SELECT string_agg(printf('%02x', xor(('0x' || k[2 * i + 1 : 2 * i + 2])::INTEGER, 54)), '' ORDER BY i) AS ipad, string_agg(printf('%02x', xor(('0x' || k[2 * i + 1 : 2 * i + 2])::INTEGER, 92)), '' ORDER BY i) AS opad
  FROM k, (SELECT unnest(range(64)) AS i))
SELECT DISTINCT source, sha256(unhex(opad) || unhex(sha256(unhex(ipad) || source::BLOB)))[1:16] AS pseudonym,
  CASE WHEN length(source) <= 1 THEN '*' WHEN length(source) = 2 THEN source[1:1] || '*' ELSE source[1:1] || repeat('*', length(source) - 2) || right(source, 1) END AS shown, sha256(source) AS digest FROM documents, p""",
    "length_bands": """
SELECT CAST(CASE WHEN length(text) >= 400 THEN 4 WHEN length(text) >= 150 THEN 3 WHEN length(text) >= 60 THEN 2 WHEN length(text) >= 20 THEN 1 ELSE 0 END AS INTEGER) AS band,
  count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest FROM documents GROUP BY 1""",
    "sentence_counts": r"""
WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^。！？；!?;.\n]*[。！？；!?;.\n]|[^。！？；!?;.\n]+$'), lambda x: trim(replace(x, chr(10), ''))), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(p) AS BIGINT) AS pieces, CAST(list_max(list_transform(p, lambda x: length(x))) AS INTEGER) AS longest FROM p""",
    "source_digests": """
SELECT DISTINCT source, CASE WHEN length(source) <= 1 THEN '*' WHEN length(source) = 2 THEN source[1:1] || '*' ELSE source[1:1] || repeat('*', length(source) - 2) || right(source, 1) END AS shown,
  sha256(source) AS digest FROM documents""",
    "gram_df": f"WITH {_GRAMS} SELECT gram, count(*) AS df FROM grams GROUP BY gram",
    "blocking_keys": f"WITH {_KEYS} SELECT item_id, gram, df FROM keys",
    "candidate_pairs": f"WITH {_KEYS} SELECT a.item_id AS left_id, b.item_id AS right_id, count(*) AS shared_keys FROM keys a JOIN keys b ON a.gram = b.gram AND a.item_id < b.item_id GROUP BY 1, 2",
    "near_components": f"""
WITH RECURSIVE d AS (SELECT doc_id, 'k' || {_KEY} AS key FROM documents UNION ALL SELECT doc_id, 'f' || string_split(text, chr(10))[1] FROM documents WHERE length(string_split(text, chr(10))[1]) >= 30),
star AS (SELECT doc_id AS a, min(doc_id) OVER (PARTITION BY key) AS b FROM d),
edge AS (SELECT DISTINCT a, b FROM star WHERE a <> b UNION SELECT DISTINCT b, a FROM star WHERE a <> b),
reach AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT edge.b, reach.c FROM reach JOIN edge ON reach.a = edge.a)
SELECT a AS doc_id, min(c) AS component FROM reach GROUP BY a""",
    "word_log_ratio": """
WITH w AS (SELECT toxic, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents JOIN labels USING (doc_id)),
s AS (SELECT term, count(*) FILTER (toxic = 1) + 1.0 AS a, count(*) FILTER (toxic <> 1) + 1.0 AS b FROM w GROUP BY term),
t AS (SELECT CAST(sum(a) AS DOUBLE) AS ta, CAST(sum(b) AS DOUBLE) AS tb FROM s)
SELECT term, round(ln((CAST(a AS DOUBLE) / ta) / (CAST(b AS DOUBLE) / tb)), 6) AS log_ratio FROM s, t""",
}
