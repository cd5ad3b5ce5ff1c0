import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tessarine import cli
from tessarine.adapters import VectorStore
from tessarine.engine import Engine
from tessarine.operators.lexical import document_frequencies
from tessarine.plans.parser import SqlError
from tessarine.sources import readers
from tessarine.sources.embedders import Embedder, SparseEncoder
from tessarine.streaming import sync

NOW = 1706745600000
DOCS = [{"text": "Nikola Tesla alternating current motor", "tag": "history", "rank": 9, "at": "2024-01-31"}, {"text": "Marie Curie radioactivity", "tag": "science", "rank": 10, "at": "2023-01-31"}, {"text": "Tesla coil patent", "tag": "patent", "rank": 100}, {"text": "the motor current", "tag": "patent"}]


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), NOW)
    e.sql("CREATE TABLE docs (rank INT, at DATE) USING text")
    e.add("docs", spark.createDataFrame([(d["text"], d["tag"], d.get("rank"), d.get("at")) for d in DOCS], "text string, tag string, rank int, at string").coalesce(1))
    return e


def col(result, name):
    return [r[name] for r in result.df.collect()]


def test_search_and_where(engine):
    assert col(engine.sql("SELECT id FROM docs SPARSE SEARCH text BM25('tesla motor') LIMIT 1"), "id") == [0]
    assert col(engine.sql("SELECT id FROM docs SPARSE SEARCH text BM25('tesla') WHERE tag = 'patent'"), "id") == [2]
    assert col(engine.sql("SELECT id FROM docs WHERE rank > 9 ORDER BY rank"), "id") == [1, 2]
    assert col(engine.sql("SELECT id FROM docs WHERE at >= '2023-06-01'"), "id") == [0]
    assert engine.sql("SELECT id FROM docs SPARSE SEARCH text BM25('motor current') FACETS(tag) LIMIT 1").facet_counts() == {"tag": [("history", 1), ("patent", 1)]}
    r = engine.search("docs", "motor", highlight=True, boosts={"rank": 5.0}, decay=("at", 1.0))
    assert r.to_dict()["doc_id" if "doc_id" in r.df.columns else "id"] == [0, 3]
    assert "<em>motor</em>" in r.to_dict()["snippet"][0]
    plan = engine.sql("EXPLAIN SELECT id FROM docs SPARSE SEARCH text BM25('motor')")
    assert plan.explain_text.startswith("RetrievalScan") and plan.provenance().count() > 0
    assert engine.sql("EXPLAIN SELECT id FROM docs WHERE id = 1").explain_text.startswith("TableScan") and "id_lookup" in engine.sql("EXPLAIN SELECT id FROM docs WHERE id = 1").explain_text


@pytest.mark.parametrize("strategy", ["default", "bm25", "text", "hyde", "crag", "graph", "distributed", "splade"])
def test_strategies(engine, strategy):
    assert 0 in engine.search("docs", "tesla motor", strategy=strategy).to_dict()["id"]


def test_inline_filters_fetch_log_bulk(engine, tmp_path):
    assert engine.search("docs", "tesla tag:patent").to_dict()["id"] == [2]
    assert sorted(engine.search("docs", "motor current #at").to_dict()["id"]) == [0]
    assert sorted(r[0] for r in engine.fetch("docs", [1, 3, 50]).select("id").collect()) == [1, 3]
    engine.search("docs", "tesla", log=str(tmp_path / "log"))
    assert engine.searches(str(tmp_path / "log")).first()["query"] == "tesla"
    engine.create_index("docs", "bm25")
    with engine.bulk("docs") as e:
        e.add("docs", ["tesla one", "tesla two"])
    assert engine.table("docs").index and len(engine.search("docs", "tesla").to_dict()["id"]) == 4


def test_adapters_and_cli(engine, capsys):
    store = VectorStore(engine, "docs")
    store.add_texts(["quiet harbour"], [{"tag": "sea"}])
    assert store.similarity_search("harbour", 1)[0]["id"] == 4
    assert cli.main(["sql", engine.path, "SELECT id, tag FROM docs WHERE tag = 'sea'"], engine.spark) == 0
    assert cli.main(["query", engine.path, "docs", "harbour"], engine.spark) == 0
    assert cli.main(["reindex", engine.path, "docs"], engine.spark) == 0 and cli.main(["tables", engine.path], engine.spark) == 0
    out = capsys.readouterr().out
    assert "id\ttag\n4\tsea" in out and "docs\t5" in out


def test_groups(engine):
    assert {r[0]: r[1] for r in engine.sql("SELECT tag, COUNT(*) FROM docs GROUP BY tag").df.collect()} == {"history": 1, "science": 1, "patent": 2}
    assert [tuple(r) for r in engine.sql("SELECT tag, SUM(rank) AS s FROM docs GROUP BY tag HAVING s > 9").df.collect()] == [("patent", 100.0), ("science", 10.0)]
    assert col(engine.sql("SELECT COUNT(*) FROM docs"), "count") == [4]
    assert col(engine.sql("SELECT COUNT(*) AS n FROM docs SPARSE SEARCH text BM25('tesla')"), "n") == [2]
    with pytest.raises(SqlError):
        engine.sql("SELECT rank, COUNT(*) FROM docs GROUP BY tag")


def test_delete_compact_reopen(engine, spark):
    assert engine.delete("docs", [0, 77]) == 1
    assert col(engine.sql("SELECT COUNT(*) FROM docs"), "count") == [3]
    assert "compacted" in col(engine.sql("COMPACT TABLE docs FULL"), "message")[0]
    again = Engine(spark, engine.path, NOW)
    assert sorted(col(again.sql("SELECT id FROM docs"), "id")) == [1, 2, 3]
    again.add("docs", [{"text": "new one"}, "plain"])
    assert sorted(col(again.sql("SELECT id FROM docs"), "id")) == [1, 2, 3, 4, 5]
    again.sql("ALTER TABLE docs ALTER COLUMN rank TYPE float REWRITE")
    assert dict(again.table("docs").df.dtypes)["rank"] == "double"
    assert col(again.sql("SELECT id FROM docs WHERE rank = 100"), "id") == [2]
    assert again.sql("SHOW TABLES").df.first()["rows"] == 5
    again.sql("DROP TABLE docs")
    with pytest.raises(SqlError):
        again.table("docs")


def test_index_is_used_until_stale(engine):
    engine.sql("CREATE INDEX i ON docs (text) USING BM25")
    assert engine.table("docs").index and col(engine.sql("SELECT id FROM docs SPARSE SEARCH text BM25('tesla motor') LIMIT 1"), "id") == [0]
    assert col(engine.sql("SHOW INDEXES FROM docs"), "index") == ["text"]
    engine.delete("docs", [0])
    assert engine.table("docs").index is None and col(engine.sql("SELECT id FROM docs SPARSE SEARCH text BM25('tesla motor') LIMIT 1"), "id") == [2]


def test_views(engine):
    engine.sql("CREATE MATERIALIZED VIEW v AS SELECT id FROM docs SPARSE SEARCH text BM25('tesla') WHERE tag = 'patent'")
    assert col(engine.sql("SELECT id, tag FROM v"), "tag") == ["patent"]
    engine.add("docs", [{"text": "tesla again", "tag": "patent"}])
    assert len(col(engine.sql("SELECT id FROM v"), "id")) == 1
    engine.sql("REFRESH MATERIALIZED VIEW v")
    assert len(col(engine.sql("SELECT id FROM v"), "id")) == 2 and col(engine.sql("SHOW MATERIALIZED VIEWS"), "view") == ["v"]
    engine.sql("DROP MATERIALIZED VIEW v")
    assert engine.views() == []


def test_cte_and_join(engine):
    engine.register("cited", engine.spark.createDataFrame([("patent",), (None,)], "tag string"), "tag", None)
    assert sorted(col(engine.sql("SELECT id FROM docs JOIN cited ON docs.tag = cited.tag"), "id")) == [2, 3]
    assert col(engine.sql("WITH x AS (SELECT id, tag FROM docs WHERE tag = 'patent' ORDER BY id DESC LIMIT 1) SELECT id FROM x"), "id") == [3]
    assert sorted(r[0] for r in engine.sql("SELECT DISTINCT tag FROM docs").df.collect()) == ["history", "patent", "science"]


def test_hybrid(engine, spark):
    df = spark.createDataFrame([(0, "red car", [1.0, 0.0]), (1, "blue car", [0.0, 1.0]), (2, None, None)], "id long, text string, embedding array<float>")
    engine.register("h", df, vec_col="embedding")
    got = engine.search("h", "blue", strategy="hybrid", query_vector=[0.0, 1.0])
    assert got.to_dict()["id"][0] == 1
    assert col(engine.sql("SELECT id FROM h VECTOR SEARCH embedding ANN('1,0') LIMIT 1"), "id") == [0]
    engine.register("plain", df.select("id", "text"))
    engine.with_proxy_vectors("plain")
    assert engine.search("plain", "red car", strategy="dense").to_dict()["id"][0] == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\n two\nmore \n\n\n")
    assert sorted(r[0] for r in readers.text_file(spark, str(tmp_path / "a.txt")).collect()) == ["one", "two\nmore"]
    assert readers.text_file(spark, str(tmp_path / "a.txt"), "line").count() == 3
    (tmp_path / "a.jsonl").write_text('{"passage": "p", "x": 1}\n\n{"text": "t", "content": "c"}\n{"x": 2}\n')
    assert sorted(r[0] for r in readers.jsonl(spark, str(tmp_path / "a.jsonl")).collect()) == ["p", "t"]
    m = readers.mapped(spark.createDataFrame([("a", "[1,2]", 3)], "body string, v string, k int"), readers.Mapping("body", vector_column="v"))
    assert m.first().asDict() == {"text": "a", "k": 3, "embedding": [1.0, 2.0]}
    assert readers.rows(spark, ["s", {"text": "d", "vector": [1, 2], "n": 1, "sparse": {"a": 2}}]).where("text = 'd'").first()["sparse"] == {"a": 2.0}


class _Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        at, size = int(q["offset"][0]), int(q["limit"][0])
        body = json.dumps({"data": [{"id": i, "nested": [i]} for i in range(at, min(at + size, 25))]}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_http(spark):
    server = HTTPServer(("127.0.0.1", 0), _Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/items"
    for more in ({}, {"total": 25, "parts": 3}):
        df = readers.http_json(spark, url, "data", pageSize=10, **more)
        assert sorted(int(r["id"]) for r in df.collect()) == list(range(25)) and df.first()["nested"] == "[0]"
    server.shutdown()


def test_sync(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "db"), NOW)
    m = readers.Mapping("t", cursor_column="c")
    rows = spark.createDataFrame([("a", 9), ("b", 10), ("c", 10), ("d", 11), ("n", None)], "t string, c int")
    assert sync.incremental_sync(e, "s", rows, m, limit=2).rows == 3  # ties with the last value come along
    assert sync.incremental_sync(e, "s", rows, m).rows == 1 and sync.incremental_sync(e, "s", rows, m).rows == 0
    assert sync.full_sync(e, "s", rows, m).rows == 5 and e.table("s").df.count() == 5


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    e = Engine(spark, str(tmp_path / "db"), NOW)
    m = readers.Mapping("text")
    for batch in (["a b", "b c"], ["c d"]):
        spark.createDataFrame([(t,) for t in batch], "text string").coalesce(1).write.mode("append").parquet(source)
        run = sync.stream_sync(e, "s", spark.readStream.schema("text string").parquet(source), m, str(tmp_path / "check"), frequencies=str(tmp_path / "df"))
        run.awaitTermination()
    assert e.table("s").df.count() == 3
    got = {r[0]: r[1] for r in sync.frequencies_of(e, str(tmp_path / "df")).collect()}
    assert got == {r[0]: r[1] for r in document_frequencies(e.table("s").df).collect()} == {"a": 1, "b": 2, "c": 2, "d": 1}


def test_embedders(spark):
    df = spark.createDataFrame([("ab",), (None,), ("c",)], "t string")
    assert [r[0] for r in df.select(Embedder(lambda ts: [[len(t), 1] for t in ts]).column(F.col("t"))).collect()] == [[2.0, 1.0], None, [1.0, 1.0]]
    assert df.select(SparseEncoder(lambda ts: [{t: 1} for t in ts]).column(F.col("t"))).first()[0] == {"ab": 1.0}
    with pytest.raises(ValueError):
        Embedder(lambda ts: [[1.0]] * len(ts), dim=2).embed(["a"])
