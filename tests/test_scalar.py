import datetime

import pytest
from pyspark.sql import functions as F

from tessarine.functions.scalar import Scope
from tessarine.plans.parser import parse

NOW = 1706745600000


@pytest.fixture(scope="module")
def scope(spark):
    ts = datetime.datetime(2024, 1, 15, 10, 30, 45)
    df = spark.createDataFrame([(1, "Hi There", "10", -7.5, ts, True, {"k": "5.0"}, None), (2, None, "abc", 2.5, None, None, {}, "x")], "id long, title string, rank string, amount double, at timestamp_ntz, flag boolean, metadata map<string,string>, other string")
    return Scope(df, meta_col="metadata", now_ms=NOW)


def one(scope, text):
    e = parse(f"SELECT {text} AS v FROM t").items[0].expr
    return scope.df.orderBy("id").select(scope.value(e).col).first()[0]


@pytest.mark.parametrize("text,want", [("substr(title, 4, 3)", "The"), ("substr(title, -3, 2)", "Hi"), ("substr(title, 99)", ""), ("substr(title, 2, 0)", ""), ("concat(title, missing, rank)", "Hi There10"), ("trim(concat(' ', title))", "Hi There"), ("length(amount)", 4), ("length(abs(amount))", 3), ("round(amount)", -8), ("round(2.345, 2)", 2.35), ("mod(-7, 3)", -1), ("mod(7, 0)", None), ("floor(amount)", -8), ("ceil(amount)", -7), ("abs(title)", None), ("nullif(k, 5)", None), ("nullif(title, 'x')", "Hi There"), ("ifnull(missing, 'd')", "d"), ("coalesce(missing, rank)", "10"), ("date_trunc('hour', at)", "2024-01-15T10:00:00"), ("date_trunc('week', at)", None), ("extract('minute', at)", 30), ("extract('year', '2023/05/06')", 2023), ("age('2024-01-31T23:59:59.500Z')", 500), ("now()", NOW), ("lower(title)", "hi there"), ("upper(title)", "HI THERE")])
def test_functions(scope, text, want):
    assert one(scope, text) == want


@pytest.mark.parametrize("where,ids", [("rank > 9", [1]), ("rank = 10.0", [1]), ("rank > 'aaa'", []), ("lower(rank) > 'aaa'", [2]), ("title != 'x'", [1]), ("title NOT LIKE 'z%'", [1]), ("title LIKE 'H_ T%'", [1]), ("rank IN (10.0, 'abc')", [1, 2]), ("rank NOT BETWEEN 1 AND 5", [1, 2]), ("amount BETWEEN -8 AND 0", [1]), ("flag = 'yes'", [1]), ("at >= '2024-01-15'", [1]), ("at < '2024-01-15T10:30:46'", [1]), ("k = 5", [1]), ("missing = 'x'", []), ("missing != 'x' OR other = 'x'", [2]), ("id IN (2, 9)", [2])])
def test_predicates(scope, where, ids):
    p = parse(f"SELECT * FROM t WHERE {where}").where
    assert [r[0] for r in scope.df.where(scope.predicate(p)).orderBy("id").select("id").collect()] == ids


def test_backslash_and_percent_are_plain(spark):
    df = spark.createDataFrame([(1, "a\\b"), (2, "100%!")], "id long, s string")
    scope = Scope(df)
    for pattern, want in (("a\\b", 1), ("100%!", 2)):
        assert [r[0] for r in df.where(scope.predicate(parse(f"SELECT * FROM t WHERE s LIKE '{pattern}'").where)).select("id").collect()] == [want]


def test_pushdown(spark, tmp_path):
    spark.range(10).select("id", F.col("id").cast("double").alias("x")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    plan = df.where(Scope(df).predicate(parse("SELECT * FROM t WHERE x > 5 AND id = 7").where))._jdf.queryExecution().toString()
    assert "GreaterThan(x,5.0)" in plan and "EqualTo(id,7)" in plan
