import pytest

from tessarine.plans import nodes as n
from tessarine.plans.parser import SqlError, parse


def test_clauses():
    q = parse("""SELECT DISTINCT lower(title) AS t, score FROM docs JOIN c ON docs.k = c.k
        SPARSE SEARCH body BM25('it''s', k1=1.5, b=0.6) VECTOR SEARCH e ANN([1, -2.5]) FUSION K = 10 HYDE CRAG GRAPH EXPAND 2
        WHERE (a > -5 OR b NOT BETWEEN 1 AND 2) AND c NOT LIKE 'x%' AND d IN (1, 'y') BOOST(title, 2.0) BOOST(v, 1.5)
        DECAY(at, half_life=30) FACETS(tag, author) HIGHLIGHT(80) ORDER BY score ASC LIMIT 3 OFFSET 2;""")
    assert q.distinct and q.items[0] == n.Item(n.Func("lower", (n.Col("title"),)), "t")
    assert q.joins == [n.Join("c", "k", "k")] and q.lexical.text == "it's" and (q.lexical.k1, q.lexical.b) == (1.5, 0.6)
    assert q.dense.vector == [1.0, -2.5] and (q.fusion_k, q.hyde, q.crag, q.graph_depth) == (10, True, True, 2)
    assert q.where.parts[0] == n.Or((n.Cmp(n.Col("a"), ">", -5), n.Between(n.Col("b"), 1, 2, True)))
    assert q.boosts == [("title", 2.0), ("v", 1.5)] and q.decay == ("at", 30.0) and q.facets == ["tag", "author"]
    assert (q.highlight, q.order_by, q.limit, q.offset) == (80, [(n.Col("score"), False)], 3, 2)


def test_defaults():
    q = parse("select count(*), sum(x) from t group by k having count(*) > 1")
    assert [i.name for i in q.items] == ["count", "sum_x"] and q.limit == 20
    assert parse("SELECT * FROM t ORDER BY score LIMIT ALL").order_by == [(n.Col("score"), True)]


@pytest.mark.parametrize("text", ["SELECT * FROM t x", "SELECT * FROM t LEFT JOIN u ON t.a = u.a", "SELECT a FROM t UNION SELECT b FROM u", "SELECT f(x) FROM t", "SELECT lower(a, b) FROM t", "SELECT a FROM t WHERE a", "SELECT a FROM t LIMIT 1 LIMIT 2", "DELETE FROM t WHERE x = 1", "SELECT a FROM t WHERE NOT a = 1", "EXPLAIN STREAM SELECT a FROM t", "SELECT a FROM t ~"])
def test_unknown_is_an_error(text):
    with pytest.raises(SqlError):
        parse(text)


def test_statements():
    assert parse("CREATE TABLE a.b (x INT, v VECTOR[4], d DECIMAL(10, 2)) USING text") == n.CreateTable("a.b", [("x", "int"), ("v", "vector(4)"), ("d", "decimal(10,2)")], "text")
    assert parse("DELETE FROM t WHERE id = 3 OR id IN (1, 2)") == n.Delete("t", [1, 2, 3])
    assert parse("ALTER TABLE t ALTER COLUMN y TYPE int REWRITE") == n.AlterType("t", "y", "int", True)
    assert parse("COMPACT TABLE t FULL").verb == "compact_full"
    assert parse("CREATE MATERIALIZED VIEW v AS SELECT id FROM t SPARSE SEARCH text BM25('a') WHERE x = 1;").text.endswith("WHERE x = 1")
