"""The registered queries of the retrieval engine, each over its whole tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions import vectors
from .functions.text import highlight, proxy_embedding, tokens, vector_literal
from .operators import dense, fusion, lexical, olap
from .sources import readers
from .streaming import sync

NOW = 1706745600000  # 2024-02-01T00:00:00
QUERY = "the thing and enheit"
VECTOR = [((i * 37) % 11 - 5) / 10 for i in range(64)]

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

TABLES = {
    "documents": ("doc_id", "text", None), "embeddings": ("vec_id", None, "embedding"), "labels": ("doc_id", None, None), "benchmark": ("item_id", "text", None), "conversations": ("conv_id", "text", None), "pages": ("page_id", "html", None),
    "events": ("event_id", None, None), "lineitem": ("l_orderkey", None, None), "orders": ("o_orderkey", None, None), "customer": ("c_custkey", None, None), "part": ("p_partkey", None, None), "supplier": ("s_suppkey", None, None), "nation": ("n_nationkey", None, None), "region": ("r_regionkey", None, None),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, path: str | None = None) -> Engine:
    out = Engine(spark, path, now_ms=NOW)
    for name, (id_col, text_col, vec_col) in TABLES.items():
        out.register(name, table(spark, sf_dir, name), id_col, text_col, vec_col)
    return out


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a temporary one only in a single local process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessarine-")
    return f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}"


def query(oracle: str | None = None):
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _sql[f.__name__] = oracle
        return f

    return keep


def statement(name: str, text: str, oracle: str) -> None:
    """Register a query that is one statement of the dialect."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir).sql(text).df

    run.__name__ = name
    query(oracle)(run)


# scans, predicates, order

statement("scan_filter", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05 AND l_returnflag = 'R' LIMIT ALL",
          "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05 AND l_returnflag = 'R'")
statement("scan_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type NOT LIKE 'S_%' LIMIT ALL",
          "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%e%' AND p_type NOT LIKE 'S_%'")
statement("scan_between_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice NOT BETWEEN 20000 AND 300000 AND o_orderstatus IN ('F', 'O') LIMIT ALL",
          "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice NOT BETWEEN 20000 AND 300000 AND o_orderstatus IN ('F', 'O')")
statement("scan_or_and", "SELECT c_custkey, c_acctbal FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 5000.5) OR (c_nationkey IN (1, 2, 3) AND c_acctbal < -500) LIMIT ALL",
          "SELECT c_custkey, c_acctbal FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 5000.5) OR (c_nationkey IN (1, 2, 3) AND c_acctbal < -500)")
statement("scan_func_predicate", "SELECT p_partkey FROM part WHERE lower(p_brand) >= 'brand#3' AND length(p_name) > 12 LIMIT ALL",
          "SELECT p_partkey FROM part WHERE lower(p_brand) >= 'brand#3' AND length(p_name) > 12")
statement("scan_dates", "SELECT event_id, ts FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-12T12:30:00' LIMIT ALL",
          "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12 12:30:00'")
statement("id_lookup", "SELECT id, lang, source FROM documents WHERE id = 3 OR id IN (5, 8, 13, 100000000)",
          "SELECT doc_id AS id, lang, source FROM documents WHERE doc_id IN (3, 5, 8, 13, 100000000)")
statement("project_star", "SELECT * FROM documents LIMIT ALL", "SELECT doc_id, CAST(0 AS DOUBLE) AS score, text FROM documents")
statement("order_by_typed", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC LIMIT 50 OFFSET 10",
          "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 10")
statement("order_by_func", "SELECT p_partkey, length(p_name) AS len FROM part ORDER BY length(p_name) DESC LIMIT 40",
          "SELECT p_partkey, length(p_name) AS len FROM part ORDER BY length(p_name) DESC, p_partkey LIMIT 40")
statement("limit_offset", "SELECT id, n_chars FROM documents ORDER BY n_chars ASC LIMIT 25 OFFSET 5",
          "SELECT doc_id AS id, n_chars FROM documents ORDER BY n_chars NULLS FIRST, doc_id LIMIT 25 OFFSET 5")
statement("distinct", "SELECT DISTINCT lang, source FROM documents LIMIT ALL", "SELECT DISTINCT lang, source FROM documents")
statement("distinct_expr", "SELECT DISTINCT upper(event_type) AS kind, extract('hour', ts) AS hour FROM events LIMIT ALL",
          "SELECT DISTINCT upper(event_type) AS kind, CAST(extract(hour FROM ts) AS BIGINT) AS hour FROM events")

# scalar functions

statement("fn_string", "SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b, substr(c_name, 3, 5) AS c, substr(c_name, -2) AS d, trim(concat('  ', c_name, ' ')) AS e, length(c_name) AS f FROM customer LIMIT ALL",
          "SELECT c_custkey, lower(c_name) AS a, upper(c_mktsegment) AS b, substr(c_name, 3, 5) AS c, c_name AS d, c_name AS e, length(c_name) AS f FROM customer")
statement("fn_numeric", "SELECT c_custkey, abs(c_acctbal) AS a, floor(c_acctbal) AS b, ceil(c_acctbal) AS c, round(c_acctbal) AS d, round(c_acctbal, 1) AS e, mod(c_custkey, 7) AS f, mod(c_custkey, 0) AS g FROM customer LIMIT ALL",
          "SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS b, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(round(c_acctbal) AS BIGINT) AS d, round(c_acctbal * 10.0::DOUBLE) / 10.0::DOUBLE AS e, c_custkey % 7 AS f, CAST(NULL AS BIGINT) AS g FROM customer")
statement("fn_date", "SELECT event_id, date_trunc('month', ts) AS a, date_trunc('hour', ts) AS b, extract('year', ts) AS c, extract('minute', ts) AS d, extract('epoch', ts) AS e, age(ts) AS f, now() AS g FROM events LIMIT ALL",
          f"SELECT event_id, strftime(date_trunc('month', ts), '%Y-%m-%dT%H:%M:%S') AS a, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS b, extract(year FROM ts) AS c, extract(minute FROM ts) AS d, CAST(floor((epoch_us(ts) // 1000) / 1000) AS BIGINT) AS e, {NOW} - (epoch_us(ts) // 1000) AS f, CAST({NOW} AS BIGINT) AS g FROM events")
statement("fn_conditional", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS a, coalesce(nullif(o_orderstatus, 'O'), 'open') AS b, ifnull(missing, 'none') AS c, nullif('5', '5.0') AS d FROM orders LIMIT ALL",
          "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS a, coalesce(nullif(o_orderstatus, 'O'), 'open') AS b, 'none' AS c, CAST(NULL AS VARCHAR) AS d FROM orders")

# grouping and joins

statement("group_count", "SELECT lang, COUNT(*) AS docs FROM documents GROUP BY lang LIMIT 0", "SELECT coalesce(lang, '_null') AS lang, count(*) AS docs FROM documents GROUP BY 1")
statement("group_multi_agg", "SELECT l_returnflag, l_linestatus, COUNT(*), SUM(l_quantity) AS q, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus LIMIT 0",
          "SELECT coalesce(l_returnflag, '_null') AS l_returnflag, coalesce(l_linestatus, '_null') AS l_linestatus, count(*) AS count, sum(l_quantity) AS q, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2")
statement("group_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12 LIMIT 0", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
statement("group_having_key", "SELECT p_brand, COUNT(*) FROM part GROUP BY p_brand HAVING p_brand LIKE '%#1%' AND COUNT(*) >= 2 LIMIT 0",
          "SELECT p_brand, count(*) AS count FROM part GROUP BY 1 HAVING p_brand LIKE '%#1%' AND count(*) >= 2")
statement("group_func_key", "SELECT date_trunc('day', ts) AS day, COUNT(*) AS n, SUM(round(value)) AS v FROM events GROUP BY date_trunc('day', ts) LIMIT 0",
          "SELECT coalesce(strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%S'), '_null') AS day, count(*) AS n, sum(round(value)) AS v FROM events GROUP BY 1")
statement("group_by_id", "SELECT id, COUNT(*) AS n FROM documents GROUP BY id LIMIT 0", "SELECT doc_id AS id, count(*) AS n FROM documents GROUP BY 1")
statement("group_paged", "SELECT event_type, COUNT(*) AS n FROM events WHERE value > 10 GROUP BY event_type LIMIT 3 OFFSET 1",
          "SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY 1 ORDER BY 1 LIMIT 3 OFFSET 1")
statement("global_count", "SELECT COUNT(*) AS n FROM lineitem WHERE l_shipdate >= '1995-01-01'", "SELECT count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01'")
statement("trivial_count", "SELECT COUNT(*) FROM lineitem", "SELECT count(*) AS count FROM lineitem")
statement("agg_over_func", "SELECT o_orderstatus, SUM(abs(floor(o_totalprice))) AS s, AVG(length(o_orderpriority)) AS a FROM orders GROUP BY o_orderstatus LIMIT 0",
          "SELECT o_orderstatus, sum(abs(floor(o_totalprice)))::DOUBLE AS s, avg(length(o_orderpriority)) AS a FROM orders GROUP BY 1")
statement("semi_join", "SELECT c_custkey, c_name FROM customer JOIN orders ON customer.c_custkey = orders.o_custkey WHERE c_acctbal > 0 LIMIT ALL",
          "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders)")
statement("semi_join_group", "SELECT lang, COUNT(*) AS n FROM documents JOIN labels ON documents.doc_id = labels.doc_id GROUP BY lang LIMIT 0",
          "SELECT coalesce(lang, '_null') AS lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
statement("cte_compose", "WITH good AS (SELECT doc_id, quality FROM labels WHERE quality = 1 LIMIT ALL) SELECT doc_id, source FROM documents JOIN good ON documents.doc_id = good.doc_id WHERE n_chars > 500 LIMIT ALL",
          "SELECT doc_id, source FROM documents WHERE n_chars > 500 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")

statement("cte_limit", "WITH x AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20) SELECT COUNT(*) AS n FROM x", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20)")
statement("cte_no_limit", "WITH x AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000) SELECT COUNT(*) AS n FROM x", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
statement("untyped_compare", "SELECT event_id, substr(props, 1, 4) AS head FROM events WHERE substr(props, 1, 1) = '{' AND nullif(event_type, 'view') != 'click' LIMIT ALL",
          "SELECT event_id, substr(props, 1, 4) AS head FROM events WHERE substr(props, 1, 1) = '{' AND event_type <> 'view' AND event_type <> 'click'")

# facets


@query("""
with c as (select 'lang' as field, coalesce(lang, '_null') as value, count(*) as count from documents group by 2),
r as (select *, row_number() over (partition by field order by count desc, value) as rank from c)
select field, value, count, cast(rank as integer) as rank from r where rank <= 3""")
def facets_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return olap.facets(table(spark, sf_dir, "documents"), e.table("documents").scope(NOW), ["lang"], 3)


@query("""
with c as (select 'event_type' as field, coalesce(event_type, '_null') as value, count(*) as count from events group by 2
  union all select 'user_id', coalesce(cast(user_id as varchar), '_null'), count(*) from events group by 2),
r as (select *, row_number() over (partition by field order by count desc, value) as rank from c)
select field, value, count, cast(rank as integer) as rank from r where rank <= 20""")
def facets_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    return olap.facets(table(spark, sf_dir, "events"), e.table("events").scope(NOW), ["event_type", "user_id"])


# lexical retrieval

_TOK = r"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([a-z0-9]+|[ក-៿᧠-᧿]+)', 1)"
_TOK_DOCS = _TOK.format(text="text")


def bm25_sql(terms: str, where: str = "true", k1: float = 1.2, b: float = 0.75, settle: str = "9") -> str:
    """Common table expressions whose last, hits, is (doc_id, score); terms: SQL rows of (term, qf).

    Scores are rounded, as DuckDB adds in any order and equal texts have to tie.
    """
    return f"""
t as (select doc_id, {_TOK_DOCS} as toks, ({where}) as kept from documents),
n as (select count(*)::double as n, greatest(coalesce(sum(len(toks)), 0)::double / count(*), 1.0::double) as avgdl from t),
q(term, qf) as ({terms}),
p as (select x.doc_id, x.term, count(*)::double as tf, any_value(x.dl)::double as dl, any_value(x.kept) as kept from (select doc_id, kept, len(toks) as dl, unnest(toks) as term from t) x where x.term in (select term from q) group by 1, 2),
df as (select term, count(*)::double as df from p group by 1),
w as (select df.term, q.qf * ln((n.n - df.df + 0.5::double) / (df.df + 0.5::double) + 1.0::double) as w from df join q using (term), n),
hits as (select p.doc_id, round(sum(w.w * p.tf * ({k1}::double + 1.0::double) / (p.tf + {k1}::double * (1.0::double - {b}::double + {b}::double * p.dl / n.avgdl))), {settle}) as score from p join w using (term), n where p.kept group by 1)"""


_TERMS = "values ('the', 1), ('thing', 1), ('and', 1), ('enheit', 1)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _settled(df: DataFrame) -> DataFrame:
    """Scores to the 9 places that the oracle's ranks are made from."""
    return df.withColumn("score", F.round("score", 9))


@query(f"select term, count(*) as df from (select distinct doc_id, unnest({_TOK_DOCS}) as term from documents) group by 1")
def tokenize_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequencies(table(spark, sf_dir, "documents"))


@query(f"select term, doc_id as id, cast(count(*) as integer) as tf, cast(any_value(dl) as integer) as dl from (select doc_id, len({_TOK_DOCS}) as dl, unnest({_TOK_DOCS}) as term from documents) group by 1, 2")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(table(spark, sf_dir, "documents"), "doc_id")


@query(f"select item_id, unnest({_TOK_DOCS}) as term, count(*) as n from benchmark group by 1, 2")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


@query(f"with {bm25_sql(_TERMS)} select doc_id, round(score, 6) as score from hits order by hits.score desc, doc_id limit 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_settled(engine(spark, sf_dir).sql(f"SELECT doc_id, score FROM documents SPARSE SEARCH text BM25('{QUERY}') LIMIT 20").df))


@query(f"with {bm25_sql(_TERMS)} select doc_id, round(score, 6) as score from hits")
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_settled(lexical.bm25(table(spark, sf_dir, "documents"), QUERY, "doc_id")))


@query(f"with {bm25_sql(_TERMS, k1=1.6, b=0.4)} select doc_id, round(score, 6) as score from hits order by hits.score desc, doc_id limit 20")
def bm25_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_settled(engine(spark, sf_dir).sql(f"SELECT doc_id, score FROM documents SPARSE SEARCH text BM25('{QUERY}', k1=1.6, b=0.4) LIMIT 20").df))


@query(f"with {bm25_sql(_TERMS)} select id, round(score, 6) as score from (select doc_id as id, score from hits) order by score desc, id limit 20")
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    lexical.build_index(table(spark, sf_dir, "documents"), path, "doc_id", buckets=8)
    return _rounded(_settled(dense.top(lexical.bm25_indexed(spark, path, QUERY), 20)))


@query(f"with {bm25_sql(_TERMS, where=chr(34) + 'lang' + chr(34) + ' = ' + chr(39) + 'en' + chr(39) + ' and n_chars between 300 and 9000')} select doc_id, source, round(score, 6) as score from hits join documents using (doc_id) order by hits.score desc, doc_id limit 30")
def bm25_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_settled(engine(spark, sf_dir).sql(f"SELECT doc_id, source, score FROM documents SPARSE SEARCH text BM25('{QUERY}') WHERE lang = 'en' AND n_chars BETWEEN 300 AND 9000 LIMIT 30").df))


@query(f"with {bm25_sql(_TERMS, where='doc_id in (select doc_id from labels)')} select doc_id, round(score, 6) as score from hits order by hits.score desc, doc_id limit 20")
def bm25_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_settled(engine(spark, sf_dir).sql(f"SELECT doc_id, score FROM documents JOIN labels ON documents.doc_id = labels.doc_id SPARSE SEARCH text BM25('{QUERY}') LIMIT 20").df))


@query(f"with {bm25_sql(_TERMS)} select coalesce(lang, '_null') as lang, count(*) as n from documents where doc_id in (select doc_id from hits) group by 1")
def bm25_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(f"SELECT lang, COUNT(*) AS n FROM documents SPARSE SEARCH text BM25('{QUERY}') GROUP BY lang LIMIT 0").df


@query(f"""with {bm25_sql("values ('enheit', 1), ('thing', 1)")},
c as (select 'source' as field, coalesce(source, '_null') as value, count(*) as count from documents where doc_id in (select doc_id from hits) group by 2),
r as (select *, row_number() over (order by count desc, value) as rank from c)
select field, value, count, cast(rank as integer) as rank from r where rank <= 20""")
def bm25_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT id FROM documents SPARSE SEARCH text BM25('enheit thing') FACETS(source) LIMIT 10").facets


@query(f"with {bm25_sql(_TERMS)} select doc_id, n_chars from hits join documents using (doc_id) order by n_chars desc nulls last, doc_id limit 15")
def bm25_order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql(f"SELECT doc_id, n_chars FROM documents SPARSE SEARCH text BM25('{QUERY}') ORDER BY n_chars DESC LIMIT 15").df


@query(f"""with {bm25_sql(_TERMS).replace("hits as", "first_hits as")},
best as (select doc_id, row_number() over (order by score desc, doc_id) as r from first_hits qualify r <= 3),
toks as (select b.r, u.i, u.tok from best b join t using (doc_id), unnest(toks) with ordinality as u(tok, i) where strlen(u.tok) > 3),
ex as (select distinct tok from toks union select unnest(['the', 'thing', 'and', 'enheit'])),
ed as (select term, count(*)::double as df from (select distinct doc_id, unnest(toks) as term from t) where term in (select tok from ex) group by 1),
capped as (select term, df from ed order by df asc, term limit 32),
ep as (select x.doc_id, x.term, count(*)::double as tf, any_value(x.dl)::double as dl from (select doc_id, len(toks) as dl, unnest(toks) as term from t) x where x.term in (select term from capped) group by 1, 2),
hits as (select ep.doc_id, round(sum(ln((n.n - c.df + 0.5::double) / (c.df + 0.5::double) + 1.0::double) * ep.tf * 2.2::double / (ep.tf + 1.2::double * (0.25::double + 0.75::double * ep.dl / n.avgdl))), 9) as score from ep join capped c using (term), n group by 1)
select doc_id, round(score, 6) as score from hits order by hits.score desc, doc_id limit 20""")
def hyde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_settled(engine(spark, sf_dir).sql(f"SELECT doc_id, score FROM documents SPARSE SEARCH text BM25('{QUERY}') HYDE LIMIT 20").df))


_CONV = bm25_sql("values ('the', 1), ('and', 1)").replace("doc_id", "row").replace("from documents", "from (select row_number() over () as row, * from conversations)")


@query(f"with {_CONV} select conv_id, turn, role, round(score, 6) as score from hits join (select row_number() over () as row, * from conversations) c using (row)")
def bm25_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose id column, conv_id, is not unique: each row is a hit of its own."""
    return _rounded(_settled(engine(spark, sf_dir).sql("SELECT conv_id, turn, role, score FROM conversations SPARSE SEARCH text BM25('the and') LIMIT ALL").df))


@query(f"with {_CONV}, c as (select 'role' as field, coalesce(role, '_null') as value, count(*) as count from hits join (select row_number() over () as row, * from conversations) using (row) group by 2) select field, value, count, cast(row_number() over (order by count desc, value) as integer) as rank from c")
def facets_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).sql("SELECT conv_id FROM conversations SPARSE SEARCH text BM25('the and') FACETS(role) LIMIT 5").facets


_WEIGHTS = {"the": 0.5, "thing": 2.0, "enheit": 1.5, "and": 0.25}
_WEIGHT_ROWS = ", ".join(f"('{k}', {v}::double)" for k, v in _WEIGHTS.items())
_TF = f"e as (select doc_id, term, count(*)::double as w from (select doc_id, unnest({_TOK_DOCS}) as term from documents) group by 1, 2), q(term, qw) as (values {_WEIGHT_ROWS})"


def _sparse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.with_sparse_weights(table(spark, sf_dir, "documents"), "doc_id")


@query(f"with {_TF} select doc_id, round(sum(w * qw), 6) as score from e join q using (term) group by 1")
def splade_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexical.splade(_sparse_documents(spark, sf_dir), _WEIGHTS, "doc_id"))


@query(f"with {_TF}, r as (select *, row_number() over (partition by term order by w desc, doc_id) as r from e where term in (select term from q)) select doc_id, round(sum(w * qw), 6) as score from r join q using (term) where r <= 512 group by 1")
def seismic_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(lexical.seismic(_sparse_documents(spark, sf_dir), _WEIGHTS, "doc_id"))


@query()
def highlight_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", highlight(F.col("text"), ["the", "thing", "enheit"], 160).alias("snippet"))


# dense retrieval

_Q = "[" + ", ".join(f"{x}::double" for x in VECTOR) + "]"
_DOT = f"dots as (select vec_id, list_dot_product(embedding::double[], {_Q}) as score from embeddings where len(embedding) = 64)"


@query(f"with {_DOT} select vec_id, round(score, 6) as score from dots order by dots.score desc, vec_id limit 25")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine(spark, sf_dir).sql(f"SELECT vec_id, score FROM embeddings VECTOR SEARCH embedding ANN({VECTOR}) LIMIT 25").df)


@query(f"with {_DOT} select vec_id, round(score, 6) as score from dots")
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dense.scored(table(spark, sf_dir, "embeddings"), VECTOR, "vec_id"))


@query(f"select vec_id, round(list_dot_product(embedding[1:32]::double[], {_Q}[1:32]), 6) as score from embeddings where len(embedding) = 64")
def dense_matryoshka(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(dense.scored(table(spark, sf_dir, "embeddings"), VECTOR, "vec_id", dims=32))


@query("""
with v as (select vec_id, embedding::double[] as e from embeddings),
m as (select vec_id, e, list_min(e) as lo, greatest((list_max(e) - list_min(e)) / 255.0::double, 1.1920928955078125e-07::double) as scale from v)
select vec_id, round(lo, 6) as least, round(scale, 9) as scale, list_transform(e, lambda x: cast(least(greatest(floor((x - lo) / scale), 0), 255) as integer)) as codes from m""")
def quantize8(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "embeddings").select("vec_id", vectors.quantize8(F.col("embedding")).alias("q"))
    return coded.select("vec_id", F.round("q.min", 6).alias("least"), F.round("q.scale", 9).alias("scale"), F.col("q.codes").alias("codes"))


@query()
def turbo_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.turbo_quantize(F.col("embedding"), 4).alias("code"))


@query()
def dense_reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings")
    coded = vecs.select("vec_id", vectors.turbo_quantize(F.col("embedding"), 4).alias("code"))
    return _rounded(dense.reranked(vecs, coded, VECTOR, 25, factor=8, id_col="vec_id"))


@query()
def proxy_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", proxy_embedding(F.col("text")).alias("vector"))


@query("select vec_id, embedding from embeddings")
def vector_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_text = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("["), F.concat_ws(", ", F.transform("embedding", lambda x: x.cast("string"))), F.lit("]")).alias("t"))
    return as_text.select("vec_id", vector_literal(F.col("t")).alias("embedding"))


# fusion and re-ranking

_PAIR = f"""{bm25_sql(_TERMS, where='doc_id in (select vec_id from embeddings)').replace('hits as', 'lex as')}, {_DOT},
den as (select vec_id as doc_id, score from dots where vec_id in (select doc_id from documents)),
l as (select doc_id, row_number() over (order by score desc, doc_id) as r from lex), d as (select doc_id, row_number() over (order by score desc, doc_id) as r from den),
fused as (select doc_id, sum(1.0::double / (60 + r)) as score from (select * from l union all select * from d) group by 1)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine(spark, sf_dir)
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    e.register("hybrid", table(spark, sf_dir, "documents").join(vecs, "doc_id", "left"), "doc_id", "text", "embedding")
    return e


@query(f"""with {bm25_sql(_TERMS).replace('hits as', 'lex as')}, {_DOT},
den as (select vec_id as doc_id, score from dots where vec_id in (select doc_id from documents)),
l as (select doc_id, row_number() over (order by score desc, doc_id) as r from lex), d as (select doc_id, row_number() over (order by score desc, doc_id) as r from den),
fused as (select doc_id, sum(1.0::double / (60 + r)) as score from (select * from l union all select * from d) group by 1)
select doc_id, round(score, 9) as score from fused""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"SELECT doc_id, score FROM hybrid SPARSE SEARCH text BM25('{QUERY}') VECTOR SEARCH embedding ANN({VECTOR}) FUSION K = 60 LIMIT ALL"
    return _hybrid(spark, sf_dir).sql(text).df.withColumn("score", F.round("score", 9))


@query(f"""with {bm25_sql(_TERMS)}, h as (select doc_id, score, row_number() over (order by score) as r, count(*) over () as n from hits)
select doc_id, round(score, 6) as score from h where score >= (select score from h where r = n // 2 + 1)""")
def crag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_settled(engine(spark, sf_dir).sql(f"SELECT doc_id, score FROM documents SPARSE SEARCH text BM25('{QUERY}') CRAG LIMIT ALL").df))


@query("""
with seeds as (select doc_id as id, n_chars::double as score from documents order by n_chars desc, doc_id limit 30),
near as (select s.id + d.d as id, min(abs(d.d)) as away from seeds s, (select unnest([-2, -1, 1, 2]) as d) d group by 1),
kept as (select id from near where id not in (select id from seeds) and id in (select doc_id from documents) order by away, id limit 256)
select id as doc_id, score from seeds union all select id, 0.4::double from kept""")
def graph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seeds = docs.select("doc_id", F.col("n_chars").cast("double").alias("score")).orderBy(F.desc("score"), "doc_id").limit(30)
    return fusion.graph_expand(seeds, docs, 2, "doc_id")


@query(f"""
select event_id, value * case when trim(event_type) <> '' then 1.5::double else 1.0::double end * case when {NOW} > (epoch_us(ts) // 1000) then power(0.5::double, ({NOW} - (epoch_us(ts) // 1000)) / 86400000.0::double / 7.0::double) else 1.0::double end as final,
  value as base from events""".replace("value * case", "round(value * case").replace("end as final", "end, 6) as final"))
def boost_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("score", F.col("value"))
    scope = engine(spark, sf_dir).table("events").scope(NOW)
    out = fusion.adjusted(events, scope, [("event_type", 1.5), ("missing", 9.0)], ("ts", 7.0))
    return out.select("event_id", F.round("score", 6).alias("final"), "base")


@query(f"""with {bm25_sql("values ('enheit', 1), ('thing', 1)", settle="15")}
select doc_id, round(score * case when trim(source) <> '' then 2.0::double else 1.0::double end, 6) as score from hits join documents using (doc_id) order by score * case when trim(source) <> '' then 2.0::double else 1.0::double end desc, doc_id limit 20""".replace("order by score *", "order by hits.score *"))
def bm25_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine(spark, sf_dir).sql("SELECT doc_id, score FROM documents SPARSE SEARCH text BM25('enheit thing') BOOST(source, 2.0) LIMIT 20").df)


@query(f"with {bm25_sql(_TERMS)}, {_DOT} select doc_id, round(coalesce(dots.score, hits.score), 6) as score from hits left join dots on dots.vec_id = hits.doc_id")
def rescore_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _settled(lexical.bm25(table(spark, sf_dir, "documents"), QUERY, "doc_id"))
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _rounded(fusion.rescored(hits.join(vecs, "doc_id", "left"), "embedding", VECTOR).select("doc_id", "score"))


@query(f"""with {bm25_sql(_TERMS)}, h as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank, row_number() over (order by score) as r, count(*) over () as n from hits),
m as (select score as m from h where r = n // 2 + 1), k as (select doc_id, score, row_number() over (order by score desc, doc_id) as rank from h, m where score >= m)
select 'bm25' as stage, doc_id, round(score, 6) as score, rank, score < m as dropped from h, m union all select 'crag', doc_id, round(score, 6), rank, false from k""")
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _settled(lexical.bm25(table(spark, sf_dir, "documents"), QUERY, "doc_id"))
    return _rounded(fusion.provenance([("bm25", hits), ("crag", fusion.crag(hits, "doc_id"))], "doc_id"))


# ingest, tables on disk, views, synchronisation: the final state


@query("select doc_id, lang from documents where doc_id not in (1, 4, 6) order by doc_id")
def delete_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, scratch(spark), NOW)
    e.create_table("d", [("doc_id", "bigint"), ("lang", "text")])
    e.add("d", table(spark, sf_dir, "documents"))
    known = e.table("d").df.where(F.col("doc_id").isin(1, 4, 6)).select("id").collect()
    e.delete("d", [r[0] for r in known])
    return e.sql("SELECT doc_id, lang FROM d LIMIT ALL").df


@query("select doc_id, source, n_chars from documents where doc_id not in (2, 3)")
def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, scratch(spark), NOW)
    e.create_table("d", [("n_chars", "bigint")])
    e.add("d", table(spark, sf_dir, "documents"))
    e.delete("d", [r[0] for r in e.table("d").df.where(F.col("doc_id").isin(2, 3)).select("id").collect()])
    e.sql("COMPACT TABLE d FULL")
    return e.sql("SELECT doc_id, source, n_chars FROM d LIMIT ALL").df


@query(f"with {bm25_sql(_TERMS)} select doc_id, round(score, 6) as score from hits order by hits.score desc, doc_id limit 10")
def mv_create_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, scratch(spark))
    e.sql(f"CREATE MATERIALIZED VIEW v AS SELECT doc_id FROM documents SPARSE SEARCH text BM25('{QUERY}') LIMIT 10")
    e.sql("REFRESH MATERIALIZED VIEW v")
    return _rounded(_settled(e.sql("SELECT doc_id, score FROM v LIMIT 10").df))


@query("select event_id, event_type, value from events")
def incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("text", F.concat_ws(" ", "event_type", "props"))
    m = readers.Mapping("text", ["event_id", "event_type", "value"], cursor_column="ts")
    e = Engine(spark, scratch(spark), NOW)
    sync.incremental_sync(e, "ev", events.where("ts < timestamp_ntz'2024-01-15 00:00:00'"), m)
    sync.incremental_sync(e, "ev", events, m)
    sync.incremental_sync(e, "ev", events, m)
    return e.table("ev").df.select("event_id", "event_type", "value")


@query("select doc_id, lang, source from documents where doc_id in (3, 5, 8)")
def point_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).fetch("documents", [3, 5, 8, 100_000_000]).select("doc_id", "lang", "source")


@query("select lang, source from documents where lang = 'en' and source is not null")
def inline_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field:value`` and ``#field`` in a query's text filter the rows that are searched."""
    e, conditions = engine(spark, sf_dir), []
    rest, present = e.inline_filters("documents", "lang:en #source", conditions)
    t = e.table("documents")
    scope = t.scope(NOW)
    return t.df.where(scope.predicate(conditions[0])).where(olap.tagged(t.df, scope, present)).select("lang", "source") if not rest else t.df.limit(0)


@query("select term, count(*) as df from (select distinct doc_id, unnest(" + _TOK_DOCS + ") as term from documents) group by 1")
def merged_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lexical.merge_frequencies([lexical.document_frequencies(docs.where(f"pmod(doc_id, 3) = {i}")) for i in range(3)])


@query("select event_id, event_type from events")
def full_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, m = Engine(spark, scratch(spark), NOW), readers.Mapping("text", ["event_id", "event_type"])
    events = table(spark, sf_dir, "events").withColumn("text", F.col("event_type"))
    for _ in range(2):
        sync.full_sync(e, "ev", events, m)
    return e.table("ev").df.select("event_id", "event_type")


@query("select 'd' as table, count(*) as rows from documents")
def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, scratch(spark), NOW)
    e.sql("CREATE TABLE d (lang text) USING text")
    e.add("d", table(spark, sf_dir, "documents"))
    return e.sql("SHOW TABLES").df


@query("select doc_id, cast(n_chars as double) as n_chars from documents")
def alter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, scratch(spark), NOW)
    e.sql("CREATE TABLE d (n_chars int)")
    e.add("d", table(spark, sf_dir, "documents"))
    e.sql("ALTER TABLE d ALTER COLUMN n_chars TYPE double REWRITE")
    return e.sql("SELECT doc_id, n_chars FROM d LIMIT ALL").df


@query("select event_id, value from events")
def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    e = Engine(spark, path, NOW)
    run = sync.stream_sync(e, "ev", stream.withColumn("text", F.col("event_type")), readers.Mapping("text", ["event_id", "value"]), f"{path}/checkpoint")
    run.awaitTermination()
    return e.table("ev").df.select("event_id", "value")


@query("select text from benchmark where text <> ''")
def jsonl_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf_dir, "benchmark").select(F.col("text").alias("passage"), "item_id").write.json(path)
    return readers.jsonl(spark, path).select("text")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
