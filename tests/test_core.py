import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import quality as Q
from millrace.functions import text as T
from millrace.functions.language import by_words
from millrace.operators import corpus as C
from millrace.operators import retrieval as R
from millrace.operators.sequences import pack_first_fit, token_batches

SF = "/root/testdata/sf0.001"


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")
    return [r[0] for r in df.orderBy("id").select(f(F.col("text"))).collect()]


def test_cleaning(spark):
    assert one(spark, T.clean, "a\r\nb\tc\x07 ", None, "", "\n\n\n\n\nx\n\n\n\n\ny") == ["a\nb    c", None, "", "x\n\n\ny"]
    assert one(spark, T.clean_html, "<p>a &amp; b</p><script>x</script>") == ["a & b"]
    assert one(spark, T.clean, "a  b")[0] == one(spark, lambda c: T.clean(T.clean(c)), "a  b")[0]


def test_scores_handle_nulls_and_empty_texts(spark):
    for f in (Q.score_length, Q.score_line_lengths, Q.score_comments, Q.vocabulary_richness, Q.sentence_variation, Q.content_score, Q.code_score):
        got = one(spark, f, None, "", "One line. Two lines, then.", "x" * 3000)
        assert len(got) == 4
    assert one(spark, Q.sentence_variation, "a b. c d.")[0] == 0.0
    assert one(spark, by_words, "the cat and the dog", "el gato y la casa de los", "") == ["en", "es", "unknown"]


def test_redaction(spark):
    assert one(spark, Q.redact, "mail a.b@c.org or 10.0.0.1") == ["mail [EMAIL] or [IP]"]


def test_exact_duplicates(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, None), (4, None), (5, "c")], "id long, text string")
    got = {r.id: (r.duplicate_of, r.is_duplicate) for r in C.exact_duplicates(df, "id", T.squeeze(F.col("text"))).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, False)}


def test_jaccard_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefghijklmnop"), 40)) for _ in range(12)]
    texts = base + [b + " q" for b in base[:6]] + [base[0], None, "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")

    def sh(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    seen, want = {}, set()
    for i, t in enumerate(texts):
        if t and t.strip():
            seen.setdefault(frozenset(sh(t)), i)
    for (a, i), (b, j) in itertools.combinations(seen.items(), 2):
        if len(a & b) / len(a | b) >= 0.8:
            want.add((min(i, j), max(i, j)))
    pairs = C.jaccard_pairs(df, "id", "text")
    assert {(r.a, r.b) for r in pairs.collect()} == want
    kept = {r.id for r in C.greedy_keep(df, pairs, "id").collect()}
    assert kept == set(range(len(texts))) - {max(p) for p in want}


def test_near_dup_survivors_drop_copies(spark, tmp_path):
    from millrace.plans.corpus_queries import q_near_dup_classes, q_near_dup_pairs, q_near_dup_survivors

    a, b = " ".join(f"w{i}" for i in range(40)), "an entirely different text of seven words"
    texts = [a, a.upper(), a.replace(" ", "  "), f"{a} more", f"{a}  MORE", b, b, None, "", " ", "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.a, r.b) for r in q_near_dup_pairs(spark, str(tmp_path)).collect()} == {(0, 3)}
    assert {r.doc_id: r["class"] for r in q_near_dup_classes(spark, str(tmp_path)).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 9: 9, 10: 9}
    assert {r.doc_id for r in q_near_dup_survivors(spark, str(tmp_path)).collect()} == {0, 5, 9}


@pytest.mark.parametrize("few", [1 << 20, 120])
def test_greedy_keep_finishes_long_chains(spark, few):
    n = 130
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    chain = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    assert {r.id for r in C.greedy_keep(nodes, chain, "id", few).collect()} == set(range(0, n, 2))


def test_balance_and_split(spark):
    df = spark.createDataFrame([(i, "ab"[i % 5 == 0]) for i in range(20)], "id long, g string")
    assert C.first_n(df, "g", [F.col("id")], 3).count() == 6
    up = C.upsample(df, "g", "id", 17).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in up} == {"a": 17, "b": 17}


def test_as_of(spark):
    left = spark.createDataFrame([(1,), (5,), (9,)], "at int")
    right = spark.createDataFrame([(4, "x"), (9, "y")], "since int, v string")
    assert {r["at"]: r.v for r in C.as_of(left, right, "at", "since", "v").collect()} == {1: None, 5: "x", 9: "y"}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_knn_against_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id long, e array<double>")
    got = R.knn(df, df.where("id % 20 = 0"), "id", "e", 5, metric, block=16).collect()
    s = v @ v.T if metric == "dot" else -np.linalg.norm(v[:, None] - v[None], axis=2) if metric == "euclidean" else (v / np.linalg.norm(v, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    for q in (0, 20, 40):
        want = [j for j in np.argsort(-s[q]) if j != q][:5]
        assert [r.neighbour for r in sorted(got, key=lambda r: r.rank) if r.query == q] == want


def test_knn_ties_go_to_the_least_keys(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in reversed(range(60))], "id long, e array<double>")
    got = R.knn(df.repartition(4), df.where("id = 40"), "id", "e", 5, block=64).collect()
    assert [r.neighbour for r in sorted(got, key=lambda r: r.rank)] == [0, 1, 2, 3, 4]


def test_packing_keeps_every_sequence(spark):
    df = spark.createDataFrame([(i, (i * 37) % 90) for i in range(200)] + [(999, 700)], "id long, n long")
    got = pack_first_fit(df, "id", "n", 128).toPandas()
    assert sorted(got.id) == sorted([*range(200), 999])
    fill = got.assign(n=got.n + 1).groupby("pack").n.sum()
    assert (fill[fill < 701] <= 128).all()
    b = token_batches(df, "id", "n", 256).toPandas()
    assert len(b) == 201
    for _, g in b.groupby(["bucket", "run", "batch"]):
        assert len(g) == 1 or g.n.max() * len(g) <= 256


def _catalog():
    from millrace.plans.catalog import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", _catalog())
def test_every_query_runs(spark, name):
    from millrace.plans.catalog import ORACLES, QUERIES

    assert set(ORACLES) <= set(QUERIES)
    df = QUERIES[name](spark, SF)
    assert df.columns and len(set(df.columns)) == len(df.columns)
    assert df.count() >= 0
