"""Repeated ids, limits of common table expressions, and runs that break off."""

import pytest
from pyspark.sql import functions as F

from tessarine.engine import Engine
from tessarine.sources import fs
from tessarine.sources.readers import Mapping
from tessarine.streaming import sync


@pytest.fixture(scope="module")
def engine(spark):
    """Three rows of each id, two of them equal in all columns."""
    rows = [(i, t, [float(i), 1.0], c) for i in range(6) for t, c in (("red apple", "a"), ("red apple", "a"), (f"red pear {'pear ' * i}", "b"))]
    e = Engine(spark)
    e.register("n", spark.createDataFrame(rows, "id long, text string, vec array<double>, kind string"), vec_col="vec")
    return e


def test_every_row_is_a_hit_of_its_own(engine):
    assert engine.sql("SELECT id, kind FROM n SPARSE SEARCH text BM25('apple') LIMIT ALL").df.count() == 12
    assert engine.sql("SELECT id FROM n SPARSE SEARCH text BM25('apple') LIMIT 5").df.count() == 5
    assert engine.sql("SELECT id FROM n VECTOR SEARCH vec ANN([1.0, 0.0]) LIMIT ALL").df.count() == 18


def test_facets_boosts_order_and_groups_count_rows(engine):
    assert engine.sql("SELECT id FROM n SPARSE SEARCH text BM25('red') FACETS(kind) LIMIT 1").facet_counts() == {"kind": [("a", 12), ("b", 6)]}
    boosted = engine.sql("SELECT id, score FROM n SPARSE SEARCH text BM25('apple') BOOST(kind, 2.0) LIMIT ALL").df
    plain = engine.sql("SELECT id, score FROM n SPARSE SEARCH text BM25('apple') LIMIT ALL").df
    assert sorted(r["score"] for r in boosted.collect()) == pytest.approx(sorted(2 * r["score"] for r in plain.collect()))
    assert [r["id"] for r in engine.sql("SELECT id FROM n SPARSE SEARCH text BM25('apple') ORDER BY id DESC LIMIT 4").df.collect()] == [5, 5, 4, 4]
    assert {r["kind"]: r["n"] for r in engine.sql("SELECT kind, COUNT(*) AS n FROM n SPARSE SEARCH text BM25('pear') GROUP BY kind LIMIT 0").df.collect()} == {"b": 6}


def test_hybrid_and_filters_keep_each_row_once(engine):
    rows = engine.sql("SELECT id, kind, score FROM n SPARSE SEARCH text BM25('pear') VECTOR SEARCH vec ANN([1.0, 0.0]) FUSION K = 60 LIMIT ALL").df.collect()
    assert len(rows) == 18 and sum(r["kind"] == "b" for r in rows) == 6
    assert engine.sql("SELECT id FROM n SPARSE SEARCH text BM25('red') CRAG LIMIT ALL").df.count() <= 18


def test_limits_of_expressions(engine):
    count = lambda text: engine.sql(text).df.first()[0]
    engine.register("many", engine.table("n").df.crossJoin(engine.spark.range(6).withColumnRenamed("id", "k")))
    assert count("WITH x AS (SELECT id FROM many LIMIT 20) SELECT COUNT(*) FROM x") == 20
    assert count("WITH x AS (SELECT id FROM many LIMIT 21) SELECT COUNT(*) FROM x") == 21
    assert count("WITH x AS (SELECT id FROM many) SELECT COUNT(*) FROM x") == 108


def test_a_run_that_breaks_off_leaves_nothing(spark, tmp_path, monkeypatch):
    """The rows are written, and the process ends before the table knows: the next run takes the batch once."""
    e = Engine(spark, str(tmp_path))
    source = spark.range(30).select(F.col("id").alias("at"), F.col("id").cast("string").alias("text"))
    m = Mapping("text", ["at"], cursor_column="at")
    sync.incremental_sync(e, "t", source.where("at < 10"), m)
    with monkeypatch.context() as broken:
        broken.setattr(Engine, "save_meta", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            sync.incremental_sync(e, "t", source, m)
    assert e.table("t").df.count() == 10
    sync.incremental_sync(e, "t", source, m)
    sync.incremental_sync(e, "t", source, m)
    rows = e.table("t").df.select("id", "at").collect()
    assert sorted(r["id"] for r in rows) == list(range(30)) and len({r["at"] for r in rows}) == 30


def test_descriptions_are_replaced_in_one_step(spark, tmp_path):
    at = str(tmp_path / "x.json")
    for i in range(3):
        fs.write_json(spark, at, {"i": i})
        assert fs.read_json(spark, at) == {"i": i} and fs.names(spark, str(tmp_path))[-1] == "x.json"
