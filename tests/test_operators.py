"""Literal cases for the engine's operators."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import numeric, text
from quern.operators import authors, clusters, designs, graph, lineage, metrics, models, relational, routing, sampling, segment, similarity
from quern.sources import files
from quern.streaming import upsert


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()[0]


# --- text


@pytest.mark.parametrize(
    "raw, want",
    [
        ("ａｂｃ １２", "abc 12"),
        ("see https://a.example/x?y=1, then", "see [URL], then"),
        ("＃ 春 天 ＃ ok", "[TOPIC]春 天[/TOPIC] ok"),
        ("hi @Anna_1 you", "hi [MENTION] you"),
        ("mail a@b.example", "mail a@b.example"),
        ("x👨‍👩‍👧y", "x[EMOJI]y"),
        ("a​b\tc  d", "ab c d"),
        ("a\r\nb c\n\n\n\nd  ", "a\nb\nc\n\nd"),
        ("看 https://EXAMPLE.org/a?x=1，@小李 #春游# 出发", "看 [URL],[MENTION] [TOPIC]春游[/TOPIC] 出发"),
        ("http://a.example/x(1) www.b.example/y]. https://c.example/z.", "[URL](1) [URL]]. [URL]."),
        ("@" + "a" * 80 + " @b-. @", "[MENTION] [MENTION]-. @"),
        ("#a\n#b# x\x1fy", "#a\n[TOPIC]b[/TOPIC] x y"),
        (None, None),
    ],
)
def test_normalise(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.normalise(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("raw", ["# " + "a" * 100 + " \t#", "#" + "a" * 101 + "#", "#  # b # # c #", "# \t# #d", "x#\ny## e  f #", "# # #" + " " * 120 + "g h" + " " * 120 + "#i"])
def test_topics_without_outer_blanks_as_in_sql(spark, raw):
    import duckdb

    want = duckdb.execute(r"SELECT regexp_replace(?, '#[ \t]*([^#\n]{1,100}?)[ \t]*#', '[TOPIC]\1[/TOPIC]', 'g')", [raw]).fetchone()[0]
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(text.replace_topics(F.col("t"), outer_blanks=False)).first()[0] == want


def test_exact_key_ignores_case_width_and_blanks(spark):
    df = spark.createDataFrame([("Ｔ", "Straße a"), ("t", "STRASSE　A"), ("t", "strasse b")], "t string, b string")
    keys = [r[0] for r in df.select(text.exact_key(F.col("t"), F.col("b"))).collect()]
    assert keys[0] == keys[1] != keys[2]


    zero_width = spark.createDataFrame([("a\u200bb\r\nc", "ab\nc")], "x string, y string")
    none = F.lit(None).cast("string")
    assert zero_width.where(text.exact_key(none, F.col("x")) == text.exact_key(none, F.col("y"))).count() == 1


def test_structure_gate(spark):
    rows = [
        (None, "", "success", "invalid", "empty_title_and_body"), (None, "请先登录", "success", "invalid", "login_wall"), (None, "a", " FAILED", "invalid", "invalid_source_status"), (None, "登录 a", None, "usable", "structure_usable"),
        (None, "[URL] [EMOJI]\n", "success", "uncertain", "replacement_tokens_only"), ("a", None, "partial", "uncertain", "uncertain_source_status"), (None, "x", "success", "usable", "structure_usable"), (None, "加载中……", "unknown", "invalid", "placeholder_text"),
    ]
    df = spark.createDataFrame(rows, "t string, b string, s string, status string, reason string")
    gate = text.structure_status(F.col("t"), F.col("b"), F.col("s"))
    assert df.where((gate["status"] != F.col("status")) | (gate["reason"] != F.col("reason"))).count() == 0


def test_post_as_one_struct(spark):
    rows = [(None, "a\u200b b", "success"), ("T", '{"ops":[{"insert":"x"},{"insert":{"image":"u"}}]}', None), (None, "{broken", "success"), (None, None, "success")]
    df = spark.createDataFrame(rows, "t string, b string, s string")
    got = [r.p for r in df.select(text.normalise_post(F.col("t"), F.col("b"), F.col("s")).alias("p")).collect()]
    assert [(p.model_text, p.structure_status, p.structure_reason_code) for p in got] == [
        ("[TITLE]\n\n[BODY]\na b", "usable", "structure_usable"), ("[TITLE]\nT\n[BODY]\nx", "usable", "structure_usable"), ("[TITLE]\n\n[BODY]\n", "invalid", "invalid_json"), ("[TITLE]\n\n[BODY]\n", "invalid", "empty_title_and_body"),
    ]
    assert [p.exact_canonical_sha256 is None for p in got] == [False, False, True, True]


def test_rich_text(spark):
    rows = [
        ("plain", "plain", 0, None), ('{"ops":[{"insert":"a"},{"insert":{"image":"u"}},{"insert":"b\\n","attributes":{"bold":true}}]}', "ab\n", 1, None), ("{oops", None, None, "invalid_json"), ('{"x":1}', None, None, "missing_ops"),
        ('{"ops":[{"insert":"a","bad":1}]}', None, 0, "unknown_key"), ('{"ops":[{"insert":{"chart":1}}]}', None, 1, "unknown_embed"), ('{"ops":[{"insert":" "}]}', None, 0, "no_text"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "b string").select(text.project_rich_text(F.col("b")).alias("x"))
    for got, (_, t, embeds, reason) in zip(df.collect(), rows):
        assert (got.x.text, got.x.reason) == (t, reason)
        assert embeds is None or got.x.embeds == embeds


def test_small_text_functions(spark):
    assert one(spark, text.chinese_number(F.lit("二十三"))) == 23 and one(spark, text.chinese_number(F.lit("十"))) == 10 and one(spark, text.chinese_number(F.lit("x"))) is None
    assert one(spark, text.alternatives(F.lit(" a | |b"))) == ["a", "b"]
    assert one(spark, text.sentences(F.lit("Hi. 好！ok\nx"))) == ["Hi.", "好！", "ok", "x"]
    assert one(spark, text.char_ngrams(F.lit("aaab"), 2, 3)) == ["aa", "ab", "aaa", "aab"]
    assert one(spark, text.char_ngrams(F.lit("a"), 2, 3)) == []
    assert one(spark, text.masked(F.lit("abcd"))) == "a**d"
    assert one(spark, text.lenient_date(F.lit("2026-01-02T03:04:05Z"))) == datetime.date(2026, 1, 2)
    assert one(spark, text.lenient_date(F.lit("2026-01-02 junk"))) == datetime.date(2026, 1, 2)
    assert one(spark, text.lenient_date(F.lit("never"))) is None
    import hashlib
    import hmac

    assert one(spark, text.hmac_sha256("s", F.lit("m"))) == hmac.new(b"s", b"m", hashlib.sha256).hexdigest()[:16]
    row = spark.createDataFrame([(1, None, "é")], "b int, a string, c string")
    assert row.select(text.canonical_hash("b", "a", "c")).first()[0] == lineage.canonical_sha256({"a": None, "b": 1, "c": "é"})


# --- numbers


def test_bounds_and_quantiles():
    for events, n in ((0, 10), (3, 20), (20, 20)):
        upper = numeric.clopper_pearson(events, n, 0.95)
        tail = sum(math.comb(n, k) * upper**k * (1 - upper) ** (n - k) for k in range(events + 1))
        assert upper == 1 if events == n else abs(tail - 0.05) < 1e-6
    assert numeric.clopper_pearson(0, 0, 0.95) is None and numeric.clopper_pearson(0, 5, 0.95, "lower") == 0
    assert numeric.quantile_higher(np.array([1, 2, 3, 4]), 0.5) == 3 and numeric.nearest_index(4, 0.5) == 2


def test_vectors_and_ranges(spark):
    v = F.array(*map(F.lit, (3.0, 4.0)))
    assert one(spark, numeric.normalised(v)) == [0.6, 0.8] and one(spark, numeric.prefix(v, 1)) == [1.0]
    assert one(spark, numeric.normalised(F.array(F.lit(0.0)))) is None
    assert [tuple(r) for r in one(spark, numeric.token_ranges(F.lit(5), 2))] == [(0, 2), (2, 4), (4, 5)]
    assert one(spark, numeric.token_ranges(F.lit(0), 2)) == []
    assert one(spark, numeric.ratio_ppm(F.lit(1), F.lit(3))) == 333333 and one(spark, numeric.rate(F.lit(1), F.lit(0))) is None


# --- graph


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)] + [(500, 500), (None, 3)] + [(400, k) for k in range(401, 450)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = dict(graph.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect())
    assert got == {x: find(x) for x in root}
    assert graph.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


# --- relations and samples


def test_versions(spark):
    now = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "id int, t string, s string")
    old = spark.createDataFrame([(1, "a", None, 4), (2, "z", "x", 1), (2, "b", "w", 2)], "id int, t string, s string, v bigint")
    got = {r.id: (r.input_change, r.v) for r in relational.versioned(now, old, "id", ["t", "s"], "v").collect()}
    assert got == {1: ("unchanged", 4), 2: ("changed", 3), 3: ("new", 1)}


def test_flags_and_leaves(spark):
    assert relational.flag_violations(spark.createDataFrame([(0,), (1,), (2,), (None,)], "f int"), "f").count() == 2
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, None)], "id int, prev int")
    assert sorted(r.id for r in relational.current_leaves(chain, "id", "prev").collect()) == [3, 9]


def test_allocation_and_folds():
    assert sampling.redistributed({"a": 3, "b": 100, "c": 50}, {"a": 10, "b": 10, "c": 10}) == {"a": 3, "b": 15, "c": 12}
    assert sampling.redistributed({"z": 2, "m": 6, "a": 6}, {"z": 5, "m": 3, "a": 3}) == {"z": 2, "m": 5, "a": 4}, "ties by the targets' order"
    for population in ({"a": 1, "b": 1}, {"a": 100}):
        with pytest.raises(ValueError):
            sampling.redistributed(population, {"a": 5, "b": 5})
    k, fold = sampling.valid_folds([(f"c{i}", i % 2, 1 - i % 2) for i in range(10)], 5)
    assert k == 5 and all(sum(fold[f"c{i}"] == f for i in range(10)) == 2 for f in range(5))
    with pytest.raises(ValueError):
        sampling.valid_folds([("a", 1, 0)], 3)


def test_sample_weights(spark):
    df = spark.range(100).select("id", F.when(F.col("id") < 5, "small").otherwise("large").alias("s"))
    rows = sampling.stratified_sample(df, "s", "id", "x", 10).collect()
    assert sum(r.weight for r in rows) == 100 and {(r.s, r.inclusion) for r in rows} == {("small", 1.0), ("large", 10 / 95)}


# --- metrics and routing


def test_route_edges(spark):
    df = spark.createDataFrame([(0.31,), (0.96,), (0.5,), (None,), (float("nan"),), (1.5,)], "p double")
    assert [r[0] for r in df.select(routing.route(F.col("p"), 0.31, 0.96)).collect()] == ["auto_keep", "auto_exclude", *["manual_review"] * 4]
    assert {r[0] for r in df.select(routing.route(F.col("p"), None, 0.96)).collect()} == {"manual_review"}


def test_bootstrap_and_gates():
    low, high = metrics.component_bootstrap(np.array([[1, 2], [0, 2], [2, 2]] * 20), 1, 500)
    assert low < 0.5 < high and metrics.component_bootstrap(np.zeros((0, 2)), 1) is None
    assert metrics.acceptance_gates({"recall": 0.8, "brier": 0.1}, {"recall": 0.79, "brier": 0.2}, {"recall": 0.02, "brier": 0.05}) == {"recall": True, "brier": False}


def test_creator_roles(spark):
    both, person = ["CE_FIRSTHAND_REPEAT", "CE_PEER_ORIENTATION"], "PERSONAL_CREATOR"
    rows = [
        (person, ["EA_CREDENTIAL"], ["CE_NONE"], 3, 30, True, "KOL_TYPE"), (person, ["EA_NONE"], both, 3, 30, True, "KOC_TYPE"), (person, ["EA_SPECIALIST_HISTORY"], both, 4, 90, True, "HYBRID"),
        (person, ["EA_NONE"], ["CE_NONE"], 3, 30, True, "ORDINARY"), (person, ["EA_NONE"], both[:1], 3, 30, True, "UNK"), (person, ["EA_UNK"], both, 3, 30, True, "UNK"), (person, ["EA_CREDENTIAL"], both, 2, 30, True, "UNK"),
        (person, ["EA_NONE"], both, 3, 29, True, "ERROR"), (person, ["EA_NONE", "EA_CREDENTIAL"], both, 3, 30, True, "ERROR"), (person, ["PURCHASE"], both, 3, 30, True, "ERROR"), ("SOMEONE", [], [], 3, 30, True, "ERROR"),
        ("ORGANIZATION", [], [], 0, 0, False, "NA"), ("UNCLEAR", [], [], 9, 99, True, "UNK"), (person, None, None, 3, 30, True, "UNK"), (person, [" EA_CREDENTIAL ", ""], ["CE_NONE"], 3, 30, True, "KOL_TYPE"),
    ]
    df = spark.createDataFrame(rows, "s string, e array<string>, c array<string>, dates int, span int, profile boolean, want string")
    got = df.select("want", authors.creator_role(*(F.col(c) for c in ("s", "e", "c", "dates", "span", "profile"))).alias("r")).collect()
    assert [r.r.role for r in got] == [r.want for r in got]
    assert got[0].r.sustained == "1" and got[5].r.expert == "UNK" and got[11].r.evidence == "OUT_OF_SCOPE"


def test_joint_strata_take_the_first_that_holds(spark):
    rows = [(0.9, 0.95, "both_p_ge_0_90"), (0.2, 0.9, "qwen_only_p_ge_0_90"), (0.91, 0.6, "sparse_only_p_ge_0_90"), (0.5, 0.49, "action_disagreement_at_0_50"), (0.5, 0.89, "both_p_ge_0_50_remainder"), (0.1, 0.4, "both_p_lt_0_50")]
    df = spark.createDataFrame(rows, "p double, q double, want string")
    assert df.where(routing.joint_stratum(F.col("p"), F.col("q")) != F.col("want")).count() == 0


def test_nearest_control_of_a_large_stratum(spark):
    cases = spark.range(0, 20000, 10).select(F.lit("x").alias("g"), F.lit(1).alias("band"), (F.col("id") * 3).cast("int").alias("n"), "id")
    pool = spark.range(20000).where("id % 10 <> 0").select(F.lit("x").alias("g"), F.lit(1).alias("band"), (F.col("id") * 3).cast("int").alias("n"), "id")
    got = relational.nearest_controls(cases, pool, ["g"], "band", "n", "id").collect()
    assert len(got) == 2000 and all(r.length_gap == 3 and r.control_id == (r.case_id - 1 if r.case_id else 1) for r in got)


def test_evidence_spans(spark):
    rows = [("abcabc", "abc", None, None, "ambiguous"), ("abcabc", "abc", 3, 3, None), ("abcx", "cx", None, 2, None), ("abc", "z", None, None, "not_found"), ("abcabc", "abc", 1, None, "wrong_offset")]
    df = spark.createDataFrame(rows, "t string, q string, s int, want int, issue string")
    for r in df.select("*", authors.evidence_span(F.col("t"), F.col("q"), F.col("s")).alias("x")).collect():
        assert (r.x.start, r.x.issue) == (r.want, r.issue)


# --- similarity, segments, lineage


def test_near_pairs(spark):
    base = " ".join(f"word{k * 7919 % 1000} thing{k}" for k in range(60))
    rows = [(1, base), (2, base.replace("thing5 ", "stuff ")), (3, " ".join(f"other{k * 31}" for k in range(80))), (4, "short")]
    got = similarity.near_pairs(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()
    assert [(r.left_id, r.right_id) for r in got] == [(1, 2)] and got[0].similarity_ppm > 900_000


def test_near_pairs_need_like_lengths_and_representatives(spark):
    base = " ".join(f"word{k * 7919 % 1000} thing{k}" for k in range(60))
    rows = [(1, base), (2, base.upper()), (3, base.replace("thing5 ", "stuff ")), (5, None), (6, "")]
    kept = similarity.representatives(spark.createDataFrame(rows, "id bigint, t string"), "id", clusters.ascii_key(F.col("t")))
    assert sorted(r.id for r in kept.collect()) == [1, 3, 5, 6]
    assert [(r.left_id, r.right_id) for r in similarity.near_pairs(kept, "id", "t").collect()] == [(1, 3)]
    long = spark.createDataFrame([(1, base), (4, "\n".join([base] * 3))], "id bigint, t string")
    assert similarity.near_pairs(long, "id", "t").count() == 0
    assert similarity.near_pairs(long, "id", "t", rules=similarity.Blocking(length_ratio_ppm=0)).count() == 1


def test_units_and_curves():
    t = "第一句。第二句！」 https://x.example/a.b 三\n四"
    units = segment.build_units(t)
    assert "".join(t[u.start : u.end] for u in units) == t and len(units) == 4
    assert segment.build_units("  ") == [] and len(segment.build_units("a" * 300, 128)) == 3
    assert segment.valleys([1, 0.2, 0.2, 0.2, 1]) == [2] and segment.valleys([1, 1]) == [0] and segment.valleys([0.5]) == [0]
    assert segment.valleys([0.5, 0.5 + 6e-7, 0.5 + 12e-7], 1e-6) == [0] and segment.valleys([0.9, 0.2, 0.9, 0.2, 0.9], 1e-6) == [1, 3] and segment.valleys([]) == []
    right, up = np.eye(2)
    assert np.allclose(segment.cohesion([16, 16, 16], [right, up, up], 200), [0, 2**-0.5])
    assert np.allclose(segment.cohesion([5, 5, 5], [right, up, up], 6), [0, 2**-0.5]), "the unit at the window's edge counts"
    assert len(segment.cohesion([], np.zeros((0, 2)), 5)) == 0
    for vectors in ([right, -right, up], [right, 0 * up, up]):
        with pytest.raises(ValueError):
            segment.cohesion([5, 5, 5], vectors, 200)
    assert list(segment._short("ab, cdef" * 3, 0, 24, 5, len)) == [(0, 3), (3, 8), (8, 11), (11, 16), (16, 19), (19, 24)]
    assert np.allclose(segment.depths([0.9, 0.3, 0.7]), [0, 1.0, 0])
    assert segment.ranked([0, 1, 2], [0.5, 0.5, 0.5], [1, 1 + 1e-12, 2]) == [2, 0, 1]


def test_segments_cover_the_text(spark):
    texts = [None, " ", "One. Two.", "Day 1\n" + "山里很美。" * 60 + "\nDay 2\n" + "海边很大。" * 60, "x" * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    parts = segment.segments(docs, "id", "t", "b")
    assert segment.coverage_problems(docs, parts, "id", "t").count() == 0
    by = {k: [r for r in parts.collect() if r.source_post_id == k] for k in range(5)}
    assert not by[0] and not by[1] and any(r.text.startswith("Day 2") for r in by[3]) and all(segment.count_tokens(r.text) <= 512 for r in by[4])
    import hashlib

    assert by[2][0].segment_id == hashlib.sha256(b"b:2:0").hexdigest()


def test_short_pieces_of_plain_text_need_no_graphemes():
    slow = lambda x: segment.count_tokens(x)
    r = random.Random(4)
    for _ in range(500):
        t, limit = "".join(r.choice("ab ,:，é\n\t漢。ñ.\u0301\r👍") for _ in range(r.randint(1, 90))), r.randint(1, 9)
        assert list(segment._short(t, 0, len(t), limit, segment.count_tokens)) == list(segment._short(t, 0, len(t), limit, slow)), (t, limit)
    assert list(segment._short_plain("ab, cdef" * 3, 0, 24, 5)) == list(segment._short("ab, cdef" * 3, 0, 24, 5, slow))


def test_coverage_of_arrays_finds_what_the_table_check_finds(spark):
    seg = lambda no, t, a, b: (no, t, a, b, "end")
    rows = [
        (0, None, []), (1, "a b", [seg(0, "a b", 0, 3)]), (2, "ab cd", [seg(0, "ab", 0, 2), seg(1, "cd", 3, 5)]), (3, "ab cd", [seg(0, "ab", 0, 2)]), (4, "ab", [seg(0, "ax", 0, 2)]), (5, "x", []),
        (6, "aab", [seg(0, "aa", 0, 2), seg(1, "a", 1, 2)]), (7, "ab cd", [seg(0, "ab", 0, 2), seg(2, "cd", 3, 5)]),
    ]
    arrays = spark.createDataFrame(rows, "source_post_id bigint, text string, segments array<struct<seg_no:int,text:string,start:int,end:int,reason:string>>")
    got = {r.source_post_id: (r.held, r.gapless, r.lossless) for r in segment.coverage(arrays).collect()}
    assert got == {0: (0, True, True), 1: (2, True, True), 2: (4, True, True), 3: (2, True, False), 4: (2, True, False), 5: (0, True, False), 6: (3, True, False), 7: (4, False, True)}
    table = arrays.select("source_post_id", F.explode("segments").alias("s")).select("source_post_id", "s.*")
    assert {r.source_post_id for r in segment.coverage_problems(arrays, table, "source_post_id", "text").collect()} == {k for k, x in got.items() if not x[2]}


def test_normalisation_queries_bound_batches_and_make_parts_once(spark):
    from quern.plans import clusters as plans

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    plans.normalised_text(spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    plan = plans.normalised_posts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("replacement_tokens_only") <= 1, "the gate of a post is made once"


def test_windows_of_a_long_text_take_linear_time(spark):
    import time

    t = "aé漢👍b." * 20_000
    df = spark.createDataFrame([(t,), ("ab",), ("",), (None,), ("👍é漢x",)], "t string")
    at = time.time()
    got = [r.g for r in df.select(text.char_windows(F.col("t"), 3, 5).alias("g")).collect()]
    assert time.time() - at < 30
    assert got == [[x[i : i + w] for w in (3, 4, 5) for i in range(len(x) - w + 1)] for x in (t, "ab", "", "", "👍é漢x")]


def test_digests(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k bigint, v string")
    assert lineage.table_digest(df).first() == lineage.table_digest(df.orderBy(F.desc("k"))).first() != lineage.table_digest(df.distinct()).first()
    with pytest.raises(lineage.ContractError, match="twice"):
        lineage.require_empty(lineage.duplicates(df, ["k"]), "twice")


# --- sources, streams, models


def test_strict_csv_and_manifest(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])
    path = str(tmp_path / "in.csv")
    files.write_csv(spark.createDataFrame([(1, 'a "q", b'), (2, None)], schema), path, ["id", "t"])
    assert open(path, encoding="utf-8").read(1) == files.BOM
    assert [tuple(r) for r in files.read_strict_csv(spark, path, schema, ["id"]).collect()] == [(1, 'a "q", b'), (2, None)]
    with pytest.raises(lineage.ContractError, match="header_mismatch"):
        files.read_strict_csv(spark, path, T.StructType(schema.fields[::-1]))
    digest = files.write_manifest(str(tmp_path / "m.json"), {"b": 1, "a": "é"})
    assert files.load_manifest(str(tmp_path / "m.json"), digest) == {"a": "é", "b": 1}
    with pytest.raises(lineage.ContractError):
        files.load_manifest(str(tmp_path / "m.json"), "0")
    with pytest.raises(lineage.ContractError):
        files.strict_settings({"a": 1}, {"a": int, "b": int})


def test_vector_store_and_segments(spark, tmp_path):
    store, parts = str(tmp_path / "v"), str(tmp_path / "s")
    files.append_vectors(spark.createDataFrame([("n", "a", [1.0, 0.0])], "namespace string, sha256 string, vector array<double>"), store, 2)
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "sha256 string")
    assert [r.sha256 for r in files.missing_vectors(wanted, spark.read.parquet(store), "n").collect()] == ["b"]
    with pytest.raises(Exception, match="bad_vector"):
        files.append_vectors(spark.createDataFrame([("n", "c", [0.0, 0.0])], "namespace string, sha256 string, vector array<double>"), store, 2)
    files.write_segments(segment.segments(spark.createDataFrame([(7, "One. Two.")], "id bigint, t string"), "id", "t", "b"), parts)
    assert [r.seg_no for r in files.post_segments(spark, parts, "b", 7).collect()] == [0]


def test_streamed_upsert(spark, tmp_path):
    inbox, history, state = (str(tmp_path / x) for x in ("in", "history", "state"))
    for rows in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "id bigint, t string").write.mode("append").parquet(inbox)
        posts = spark.readStream.schema("id bigint, t string").parquet(inbox)
        upsert.start_versioned_upsert(posts, history, state, "id", ["t"]).awaitTermination()
    got = {(r.id, r.t, r.version, r.input_change) for r in spark.read.parquet(history).collect()}
    assert got == {(1, "a", 1, "new"), (2, "b", 1, "new"), (2, "c", 2, "changed"), (3, "d", 1, "new")}


def test_calibration_and_fusion():
    r = np.random.default_rng(3)
    m = r.normal(size=4000)
    y = (r.random(4000) < 1 / (1 + np.exp(-(2 * m - 1)))).astype(float)
    c = models.fit_sigmoid(m, y)
    assert abs(c.slope - 2) < 0.25 and abs(c.intercept + 1) < 0.2
    p = 1 / (1 + np.exp(-(2 * m - 1)))
    assert models.choose_fusion_weight(list(zip(p.tolist(), [0.5] * 4000, y.tolist()))) == 1.0


# --- registered queries


def test_queries_have_oracles_or_are_known_without():
    from quern.plans import catalog

    without = {"normalised_text", "normalised_posts", "near_pairs", "tail_bounds", "segments", "svm_margin_oof", "sigmoid_calibration", "conversation_cohesion"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == without and set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["cluster_key", "cluster_size", "representative", "cross_platform"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_top_k_of_many_queries_goes_in_blocks(spark):
    r = random.Random(5)
    items = spark.createDataFrame([(k, [r.uniform(-1, 1) for _ in range(4)]) for k in range(60)], "vec_id bigint, embedding array<double>")
    rows = lambda **kw: sorted(map(tuple, similarity.cosine_top_k(items, items, "vec_id", "embedding", 3, **kw).collect()))
    whole = rows()
    assert len(whole) == 180 and rows(block=20) == whole


def test_top_k_packs_pairs_and_keeps_ties_and_blank_vectors(spark, monkeypatch):
    r = random.Random(6)
    vectors = [[r.choice((-1.0, 1.0, 0.5)) for _ in range(3)] for _ in range(2500)]
    vectors[7] = vectors[11] = [0.0, 0.0, 0.0]
    items = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>")
    found = similarity.cosine_top_k(items.where("vec_id < 20"), items, "vec_id", "embedding", 4)
    unit = np.array(vectors) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
    want = set()
    for q in range(20):
        scores = [(-2.0 if q in (7, 11) or i in (7, 11) else round(float(unit[q] @ unit[i]), 6), -i) for i in range(2500) if i != q]
        want |= {(q, k + 1, -i, None if c == -2.0 else c) for k, (c, i) in enumerate(sorted(scores, reverse=True)[:4])}
    assert {tuple(x) for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan[: plan.index("NestedLoopJoin")] and plan.count("MapInPandas") >= 3, "no row for each pair"
    monkeypatch.setattr(similarity, "HELD", 64)
    ids, start = np.arange(2500), (np.full((20, 4), similarity.LEAST - 1), np.zeros((20, 4), int))
    unit[[7, 11]] = np.nan
    score, names = similarity._best(ids[:20], unit[:20], ids, unit, 4, start)
    assert {(q, k + 1, int(names[q, k])) for q in range(20) for k in range(4)} == {x[:3] for x in want}


def test_texts_are_not_read_again_by_later_steps(spark):
    from quern.plans import extras

    for query in (extras.leakage_components, extras.svm_margin_oof, extras.sigmoid_calibration):
        found = query(spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "text" not in plan and found.count() > 0, query.__name__


# --- sampling designs and resamples


def test_bucketed_sample_fills_from_the_rest_and_raises(spark):
    rows = [(f"a{k}", "rich" if k < 3 else "plain", f"g{k % 4}") for k in range(40)]
    df = spark.createDataFrame(rows, "key string, stratum string, grp string")
    got = designs.bucketed_sample(df, "stratum", (("rich", 15), ("edge", 5)), "grp", "key", "s", 25).collect()
    assert len({r.key for r in got}) == 25 and sorted(r.bucket for r in got).count("rich") == 3
    assert max(sum(r.grp == f"g{k}" for r in got) for k in range(4)) <= 8
    with pytest.raises(ValueError):
        designs.bucketed_sample(df, "stratum", (("rich", 15),), "grp", "key", "s", 41)


def test_resamples_keep_their_size_and_share_draws(spark):
    df = spark.createDataFrame([(f"c{k % 7}", k % 3 == 0, k / 100) for k in range(70)], "c string, y boolean, p double").withColumn("y", F.col("y").cast("int"))
    times = designs.multiplicities(df, "c", "x", 50)
    assert {r["sum(times)"] for r in times.groupBy("rep").sum("times").collect()} == {7}
    assert sorted(times.collect()) == sorted(designs.multiplicities(df, "c", "x", 50).collect())
    assert designs.bootstrap_ratios(df, "c", F.lit(1), F.lit(0), times).where("ratio is not null").count() == 0
    assert {(r.log_loss_delta, r.error_delta) for r in designs.paired_deltas(df, "c", "y", "p", "p", times).collect()} == {(0.0, 0.0)}
    assert designs.multiplicities(df.where("false"), "c", "x", 5).count() == 0
    agreed = designs.alpha_resamples(df.withColumn("z", F.col("y")), "c", "y", "z", (0, 1), times)
    assert {r.alpha for r in agreed.collect()} == {1.0}


def test_coverage_threshold_takes_an_actual_score(spark):
    scores = [0.1, 0.2, 0.2, 0.2, 0.9, 1.0, 0.0]
    df = spark.createDataFrame([(x,) for x in scores] + [(None,)], "p double")
    for coverage in (0.01, 0.3, 0.5, 0.7, 0.99):
        want = np.nextafter(np.quantile(scores, 1 - coverage, method="higher"), -np.inf)
        assert designs.coverage_threshold(df, "p", coverage) == want
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            designs.coverage_threshold(df, "p", bad)
    with pytest.raises(ValueError):
        designs.coverage_threshold(df.where("false"), "p", 0.5)


def test_alignment_bijection_and_guards(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "id int, x string, y int")
    right = spark.createDataFrame([(1, "a", None), (2, "B", None), (4, "d", 4)], "id int, x string, y int")
    assert {(r.id, r.state, tuple(r.changed)) for r in designs.aligned(left, right, "id", ("x", "y")).collect()} == {(1, "same", ()), (2, "changed", ("x", "y")), (3, "only_left", ()), (4, "only_right", ())}
    keys = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    assert {(r.k, r.problem) for r in designs.bijection_problems(keys(1, 1, 2, 3, None), keys(1, 2, 2, 4), "k").collect()} == {(1, "repeated_left"), (2, "repeated_right"), (3, "missing_right"), (4, "missing_left"), (None, "null_key")}
    broken = designs.guard_breaches(left, "id", [("there", right, ["id"], True), ("gone", right, ["id"], False)])
    assert {(r.id, r.guard) for r in broken.collect()} == {(3, "there"), (1, "gone"), (2, "gone")}


def test_schedule_follows_the_largest_relative_gap():
    assert designs.schedule({"p": 2, "t": 1}, {"p": 5, "t": 2}) == [(1, "t", 1), (2, "p", 1), (3, "p", 2)]
    assert designs.schedule({"p": 5, "t": 2}, {"p": 5, "t": 2})[0] == (1, "p", 1) and designs.schedule({"p": 0, "t": 0}, {"p": 1, "t": 1}) == []


def test_safest_falls_back(spark):
    df = spark.createDataFrame([("a", 0.2, 1), ("b", 0.1, 2)], "n string, loss double, k int")
    pick = lambda ok: [(r.n, r.eligible) for r in designs.safest(df, ok, [F.col("loss")], [F.col("k")]).collect()]
    assert pick(F.col("k") == 1) == [("a", True)] and pick(F.lit(True)) == [("b", True)] and pick(F.lit(None).cast("boolean")) == [("a", False)]


def test_json_changes(spark):
    rows = [('{"a":1,"b":2}', '{"b":2,"a":9}', True), ('{"a":1,"b":2}', '{"a":1,"b":3}', False), ('{"b":2}', '{"a":1,"b":2}', True), ('{"b":2,"c":1}', '{"b":2}', True), ('{"b":2}', "{}", False), ("x", "x", True), ("x", "y", False), ("[1]", "[2]", False), (None, None, True), ('{"b":{"x":[1,2]}}', '{"b":{"x":[1,2]}, "a":0}', True)]
    df = spark.createDataFrame(rows, "x string, y string, want boolean")
    assert df.where(text.json_change_allowed(F.col("x"), F.col("y"), ("a",), ("c",)) != F.col("want")).count() == 0
