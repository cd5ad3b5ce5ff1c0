"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessarine.llm import ann, fingerprints, html_density, language_id, near_dedup, packing, piece_viterbi, secret_scan, sharding, url_rules

EXTRA = ["__id", "__text", "__gone", "__at", "__hash", "__tokens", "__range", "__found", "__verdict", "__c", "__e", "score", "rank", "language", "shard", "digest", "ids", "matched_rule", "window_id", "neighbour", "t", "c"]
LONG = "password = 'k7#Qz!9w' the long text goes on " * 20_000
TEXTS = [(1, "the cat sat on the mat and looked at the other cat", "en"), (2, "the cat sat on the mat and looked at the other cat", "en"), (2, "the cat sat on the mat and looked at the other cat", "en"), (3, None, "en"), (None, "no id here", "en"), (None, None, None), (4, "", "fr"), (5, LONG, "en"), (6, "le chat est sur le tapis", "fr"), (7, "le chat", None), (8, "   \n\t ", "fr"), (9, "?!", "fr")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, None if i == 1 else "s", len(t) if t else None) for i, t, lang in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in EXTRA}).cache()


OPERATORS = {
    "secret_scan": secret_scan.scan,
    "redact": secret_scan.redact,
    "fingerprints": fingerprints.fingerprints,
    "containment": fingerprints.containment,
    "links": fingerprints.links,
    "packing": lambda d: packing.pack(d, 16),
    "near_dedup": near_dedup.groups,
    "deduplicated": near_dedup.deduplicated,
    "language": lambda d: language_id.identify(d, language_id.fit([(t, x) for _, t, x in TEXTS])),
    "kept": lambda d: language_id.keep_accepted(d, language_id.fit([(t, x) for _, t, x in TEXTS])),
    "pieces": piece_viterbi.encode,
    "sharding": lambda d: sharding.assign(d, 5),
    "html": lambda d: html_density.extract_content(d, "doc_id", "text"),
    "urls": lambda d: url_rules.flag(d, url_rules.mine(d.select(F.col("text").alias("url"), (F.col("lang") == "fr").alias("bad"))), "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(docs, name):
    rows = OPERATORS[name](docs).collect()
    one_each = {"redact", "language", "pieces", "sharding", "html", "urls"}
    if name in one_each:
        assert len(rows) == len(TEXTS)
    empty = OPERATORS[name](docs.where("false"))
    assert empty.collect() == [] and empty.columns == OPERATORS[name](docs).columns


def test_defined_results(docs):
    found = secret_scan.scan(docs).collect()
    assert {r["doc_id"] for r in found} == {5} and len(found) == 20_000 and len({r["log10_guesses"] for r in found}) == 1
    masked = {r["doc_id"]: r for r in secret_scan.redact(docs, min_cost=5.0).where("doc_id in (3, 5)").collect()}
    assert masked[3]["text"] is None and "k7#Qz" not in masked[5]["text"] and masked[5]["n_chars"] == len(masked[5]["text"])
    kept = near_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(i for i, _ in left if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9] and sum(i is None for i, _ in left) == 2
    assert [tuple(r) for r in near_dedup.groups(docs).collect()] == [(2, 1)]
    held = sorted((r["doc_id"], r["class_id"], r["contained_in"] or 0, r["containment"]) for r in fingerprints.containment(docs).collect())
    assert held == [(1, 1, 0, None), (1, 1, 1, 1.0), (2, 1, 0, None)]
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in fingerprints.links(docs).collect()) == [(1, 1, 1), (2, 1, 1)]
    judged = {r["doc_id"]: r for r in OPERATORS["language"](docs).where("doc_id in (3, 4, 8, 9, 6)").collect()}
    assert [judged[i]["language"] for i in (3, 4, 8, 9)] == [None] * 4 and not any(judged[i]["accepted"] for i in (3, 4, 8, 9)) and judged[6]["language"] == "fr"
    coded = {r["doc_id"]: r for r in piece_viterbi.encode(docs).where("doc_id in (3, 4, 5)").collect()}
    assert coded[3]["ids"] is None and coded[3]["n_tokens"] is None and coded[4]["ids"] == [] and coded[5]["round_trip"]
    shards = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 5).collect()}
    assert shards[None] == 0 and all(0 <= s < 5 for s in shards.values())
    texts = {r["doc_id"]: r for r in OPERATORS["html"](docs).collect()}
    assert texts[3]["text"] == "" and texts[3]["density_sum"] is None and texts[4]["n_nodes"] == 0


def test_packing_of_nulls_and_repeats(docs):
    rows = sorted(packing.pack(docs, 16).collect(), key=lambda r: (r["window_id"], r["window_start"]))
    assert [r["doc_id"] for r in rows if r["doc_id"] in (None, 1, 2)] == [None, 1, 2, 2, 2, 2]  # each 2 spans two windows
    assert all(r["window_end"] - r["window_start"] == r["doc_end"] - r["doc_start"] == len(r["text"].split()) for r in rows)


CLASHES = {
    "scan": (lambda d, c: secret_scan.scan(d, c), ["name", "start", "kinds"]),
    "fingerprints": (lambda d, c: fingerprints.fingerprints(d, c), ["digest", "n_bytes"]),
    "containment": (lambda d, c: fingerprints.containment(d, c), ["class_id", "containment"]),
    "links": (lambda d, c: fingerprints.links(d, c), ["class_id", "n_links"]),
    "html": (lambda d, c: html_density.extract_content(d, c, "text"), ["n_nodes", "threshold"]),
    "packing": (lambda d, c: packing.pack(d, 8, c), ["window_id", "doc_start"]),
    "groups": (lambda d, c: near_dedup.groups(d, c), ["duplicate_of"]),
    "identify": (lambda d, c: language_id.identify(d, language_id.fit([("the cat", "en"), ("le chat", "fr")], 1), c), ["language", "accepted"]),
    "encode": (lambda d, c: piece_viterbi.encode(d, c), ["ids", "n_tokens"]),
}


@pytest.mark.parametrize("name", CLASHES)
def test_an_id_column_called_like_a_result(spark, name):
    run, columns = CLASHES[name]
    df = spark.createDataFrame([(1, "password = 'k7#Qz!9w' the cat"), (2, "password = 'k7#Qz!9w' the cat")], "doc_id long, text string")
    want = run(df, "doc_id")
    for column in columns:
        got = run(df.withColumnRenamed("doc_id", column), column)
        assert len({c.lower() for c in got.columns}) == len(want.columns) and column in got.columns and f"{column}_" in got.columns
        assert sorted(r[column] for r in got.collect()) == sorted(r["doc_id"] for r in want.collect())


def test_rules_on_odd_rows(docs):
    """Enough bad rows for mining: texts as URLs, with nulls, empty, very long and repeated ones among them."""
    many = docs.crossJoin(docs.sparkSession.range(6).select(F.col("id").alias("copy"))).select(F.col("text").alias("url"), (F.col("lang") == "fr").alias("bad"))
    rules = url_rules.mine(many)
    assert rules.count() > 0
    out = url_rules.flag(docs, rules, "text")
    assert {r["doc_id"] for r in out.where("blocked").collect()} == {6, 8, 9} and out.count() == len(TEXTS)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]), (8, [float("nan"), 1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [0.5, 0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(7) for c in EXTRA})
    got = [tuple(r) for r in ann.neighbours(df, 2).orderBy("vec_id", "rank").collect()]
    assert [(a, b) for a, b, _, _ in got] == [(1, 3), (1, 10), (2, 10), (2, 1), (3, 1), (3, 10), (10, 1), (10, 2)]
    assert ann.neighbours(df.where("false")).collect() == [] and ann.neighbours(df.where("vec_id = 1")).collect() == []
    with pytest.raises(TypeError):
        ann.neighbours(df.withColumn("vec_id", F.col("vec_id").cast("string")))


def test_pipeline(spark, tmp_path):
    """Stage by stage against plain functions: language by majority words, copies, masks, windows."""
    filler = [f"the river and the old town number {i} kept their quiet market open for all of the people who came by on day {i * 7}" for i in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(filler)] + [(100 + i, "le fleuve et la vieille ville gardent le marché ouvert pour tous les gens " + f"du jour {i}", "fr") for i in range(40)]
    rows += [(200, filler[3], "en"), (201, filler[3] + " again", "en"), (202, "123 456 !!", "en"), (203, None, "en"), (204, "here is the password = 'xK9$mQ2vLp7!tR' for you and the people of the town", "en")]
    df = spark.createDataFrame([(i, t, lang, "s", len(t) if t else 0) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    one = stages["language_id"](spark, docs, str(tmp_path))
    assert ids(one) == [i for i, t, _ in sorted(rows) if i not in (202, 203)] and one.columns == docs.columns
    two = stages["near_dedup"](spark, one, str(tmp_path))
    shingles = {i: near_dedup.shingles_of(t) for i, t, _ in rows}
    group = {i: i for i in ids(one)}
    for i in group:
        for j in group:
            if i < j and near_dedup.jaccard(shingles[i], shingles[j]) >= 0.5:
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    assert ids(two) == sorted(set(group.values()))
    three = stages["secret_scan"](spark, two, str(tmp_path))
    assert "[SECRET]" in three.where("doc_id = 204").first()["text"] and three.where("text like '%[SECRET]%'").count() == 1
    four = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    stream = [(r["doc_id"], k, tok) for r in sorted(three.collect(), key=lambda r: r["doc_id"]) for k, tok in enumerate(r["text"].split())]
    want = []
    for at in range(0, len(stream), 2048):
        window = stream[at : at + 2048]
        for key in dict.fromkeys(d for d, _, _ in window):
            part = [(p, k, tok) for p, (d, k, tok) in enumerate(window) if d == key]
            want.append((at // 2048, part[0][0], part[-1][0] + 1, key, part[0][1], part[-1][1] + 1, " ".join(t for _, _, t in part)))
    assert sorted(four) == sorted(want)
