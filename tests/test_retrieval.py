import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessarine.functions import vectors
from tessarine.functions.text import hashed_vector, snippet, tokens, tokens_of, vector_literal
from tessarine.operators import dense, fusion, lexical


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(60)], k=rnd.randint(0, 40)))) for i in range(200)] + [(200, None), (201, "Über W1-w2 ក ខW3")]
    return rows, spark.createDataFrame(rows, "id long, text string").cache()


def brute_bm25(rows, query, k1=1.2, b=0.75):
    toks = {i: tokens_of(t) for i, t in rows}
    n, avg = len(rows), max(sum(map(len, toks.values())) / len(rows), 1)
    df = Counter(w for t in toks.values() for w in set(t))
    q = Counter(tokens_of(query))
    out = {}
    for i, t in toks.items():
        tf = Counter(t)
        s = sum(c * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(t) / avg)) for w, c in q.items() if tf[w])
        if s:
            out[i] = s
    return out


@pytest.mark.parametrize("query", ["w0 w3 w3 w50", "W1", "nothing here", "", "ក w59"])
def test_bm25_is_brute_force(corpus, query, spark, tmp_path):
    rows, df = corpus
    want = brute_bm25(rows, query)
    got = {r[0]: r[1] for r in lexical.bm25(df, query).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    lexical.build_index(df, str(tmp_path), buckets=4)
    indexed = {r[0]: r[1] for r in lexical.bm25_indexed(spark, str(tmp_path), query).collect()}
    assert indexed.keys() == want.keys() and all(abs(indexed[i] - want[i]) < 1e-9 for i in want)


def test_index_files_keep_their_size(corpus, spark, tmp_path):
    rows, df = corpus
    df = df.unionByName(df.where("id < 5"))  # rows of one id and text are one posting
    lexical.build_index(df, str(tmp_path), buckets=2, file_tokens=100)
    written = spark.read.parquet(f"{tmp_path}/postings")
    assert sorted(map(tuple, written.select("term", "id", "tf", "dl").collect())) == sorted(map(tuple, lexical.postings(df).collect()))
    files = Counter(r[0] for r in written.select(F.input_file_name()).collect())
    tokens_in_all = sum(len(tokens_of(t)) for _, t in rows)
    assert len(files) > tokens_in_all / 200 and max(files.values()) < 300 < written.count() / 2
    assert written.where(lexical.bucket_of(F.col("term"), 2) != F.col("bucket")).count() == 0


def test_terms_beyond_the_cap(corpus):
    _, df = corpus
    query = " ".join(f"w{i}" for i in range(60))
    stats = lexical.statistics(df, sorted(set(tokens_of(query))))
    kept = lexical.kept_terms(Counter(tokens_of(query)), stats)
    assert len(kept) == 32 and min(stats.idf(w) for w in kept) >= max(stats.idf(w) for w in stats.df if stats.df[w] and w not in kept)
    assert lexical.bm25(df, query).count() > 0


def test_tokens_agree(corpus):
    rows, df = corpus
    got = {r[0]: r[1] for r in df.select("id", tokens(F.col("text"))).collect()}
    assert all((got[i] or []) == tokens_of(t) for i, t in rows) and got[201] == ["ber", "w1", "w2", "ក", "ខ", "w3"]


def test_sparse(spark):
    df = spark.createDataFrame([(0, {"a": 1.0, "b": 2.0}), (1, {"a": 3.0}), (2, {}), (3, None)], "id long, sparse map<string,float>")
    q = {"a": 2.0, "b": 1.0, "z": 9.0}
    assert {r[0]: r[1] for r in lexical.splade(df, q).collect()} == {0: 4.0, 1: 6.0}
    assert {r[0]: r[1] for r in lexical.seismic(df, q, cut=1).collect()} == {1: 6.0, 0: 2.0}
    assert lexical.splade(df, {}).count() == 0 and lexical.seismic(df, {}).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_weights_without_python(corpus):
    rows, df = corpus
    sparse = lexical.with_sparse_weights(df)
    assert {r[0]: r[1] for r in sparse.collect()} == {i: None if t is None else Counter(tokens_of(t)) for i, t in rows}
    q = {"w0": 2.0, "w3": 0.5, "ក": 4.0}
    want = {i: sum(q[w] * c for w, c in Counter(tokens_of(t)).items() if w in q) for i, t in rows}
    scored = lexical.splade(sparse, q)
    assert {r[0]: r[1] for r in scored.collect()} == {i: s for i, s in want.items() if s}
    assert "UDF" not in plan_of(scored) and plan_of(scored).count("regexp_extract_all") == 1  # the tokens are made once


def test_seismic_without_python(corpus):
    rows, df = corpus
    q, cut, want = {"w0": 2.0, "w3": 0.5}, 7, Counter()
    for w, weight in q.items():
        entries = sorted((-Counter(tokens_of(t))[w], i) for i, t in rows if w in tokens_of(t))
        for c, i in entries[:cut]:
            want[i] -= weight * c
    scored = lexical.seismic(lexical.with_sparse_weights(df), q, cut=cut)
    assert {r[0]: r[1] for r in scored.collect()} == want
    assert "UDF" not in plan_of(scored) and plan_of(scored).count("regexp_extract_all") == 1


def test_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0]), (901, None)], "id long, embedding array<float>")
    q = rng.normal(size=20).tolist()
    want = np.argsort(-(x.astype(float) @ np.array(q)))[:5].tolist()
    assert [r[0] for r in dense.top(dense.scored(df, q), 5).collect()] == want
    coded = df.select("id", vectors.turbo_quantize(F.col("embedding"), 4, residual=True).alias("code"))
    assert [r[0] for r in dense.reranked(df, coded, q, 5, factor=8).collect()] == want
    back = df.select("id", vectors.dequantize8(vectors.quantize8(F.col("embedding"))).alias("v")).where("id = 3").first()[1]
    assert np.abs(np.array(back) - x[3]).max() <= (x[3].max() - x[3].min()) / 255 + 1e-6
    assert np.allclose(vectors.codebook(1), [-0.7979, 0.7979], atol=1e-3) and len(vectors.codebook(4)) == 16
    parsed = spark.createDataFrame([("[1, 2]",), ("3,4",), ("x",), ("[]",), (None,)], "t string").select(vector_literal(F.col("t"))).collect()
    assert [r[0] for r in parsed] == [[1.0, 2.0], [3.0, 4.0], None, None, None]


def scores(spark, values):
    return spark.createDataFrame(list(values.items()), "id long, score double")


def test_fusion(spark):
    a, b = {1: 3.0, 2: 2.0, 3: 2.0}, {3: 9.0, 4: 1.0}
    got = {r[0]: r[1] for r in fusion.rrf([scores(spark, a), scores(spark, b)]).collect()}
    assert got == pytest.approx({1: 1 / 61, 2: 1 / 62, 3: 1 / 63 + 1 / 61, 4: 1 / 62})
    many = {i: float(i % 37) for i in range(1000)}
    rank = {r["id"]: r["rank"] for r in fusion.ranked(scores(spark, many)).collect()}
    assert [i for i, _ in sorted(rank.items(), key=lambda x: x[1])] == sorted(many, key=lambda i: (-many[i], i)) and sorted(rank.values()) == list(range(1, 1001))
    assert {r[0] for r in fusion.crag(scores(spark, {1: 1.0, 2: 2.0, 3: 3.0, 4: 4.0})).collect()} == {3, 4}
    assert {r[0] for r in fusion.crag(scores(spark, {7: 1.0})).collect()} == {7}
    assert fusion.crag(scores(spark, a).where("false")).count() == 0
    docs = spark.range(10)
    assert {r[0]: r[1] for r in fusion.graph_expand(scores(spark, {0: 5.0, 5: 4.0}), docs, 1).collect()} == {0: 5.0, 5: 4.0, 1: 0.4, 4: 0.4, 6: 0.4}
    steps = fusion.provenance([("a", scores(spark, a)), ("b", scores(spark, {1: 3.0}))]).collect()
    assert {(r["stage"], r["id"]) for r in steps if r["dropped"]} == {("a", 2), ("a", 3)}


@pytest.mark.parametrize("text,terms,size,want", [("", ["a"], 50, ""), (None, ["a"], 50, None), ("a motor  runs", ["motor"], 50, "a <em>motor</em> runs"), ("no match " * 10, ["zz"], 16, "no match no matc…"), ("x" * 300 + " Tesla " + "y" * 300, ["tesla"], 40, None), ("ភាសា motor ខ្មែរ", ["motor"], 60, "ភាសា <em>motor</em> ខ្មែរ")])
def test_snippet(text, terms, size, want):
    got = snippet(text, terms, size)
    if want is None and text:
        assert got.startswith("…") and got.endswith("…") and "<em>Tesla</em>" in got
    else:
        assert got == want


def test_hashed_vector():
    assert hashed_vector("a b a", 8) == hashed_vector("b a a", 8) and abs(np.linalg.norm(hashed_vector("a b c", 8)) - 1) < 1e-9 and hashed_vector("", 4) == [0, 0, 0, 0]
