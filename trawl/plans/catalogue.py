"""Queries of the engine's own operators, each with its SQL where it has one.

The tables stand in for a collection: a document's language is its domain, a
benchmark passage is a query that is asked in every domain, and a document
that contains the passage is its gold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from trawl.functions import text
from trawl.functions.porter import with_stems
from trawl.operators import evaluate, neural, runs, stats
from trawl.operators.contained import contained_batches
from trawl.operators.index import Index, build, query_terms, tokens_of
from trawl.operators.search import Weighting, dense, search, searches, touched
from trawl.plans import oracle as O
from trawl.plans import pipeline
from trawl.shipping import ship
from trawl.sources import writers
from trawl.staging import staged, there

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LIST = ["domain", "query_id"]
TOKENS, FORM, DEPTH = "nohtml_stop", "title_weighted", 100
DEPTHS = [10, 20, 50, 100]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    ship(s)
    return s.read.parquet(f"{d}/{name}.parquet")


def corpus(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("lang").alias("domain"), "doc_id", text.given(F.col("text")).alias("text"))


def asked(s: SparkSession, d: str) -> DataFrame:
    domains = table(s, d, "documents").select(F.col("lang").alias("domain")).distinct()
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(domains)


_golds: dict[tuple[str, str], DataFrame] = {}


def gold(s: SparkSession, d: str) -> DataFrame:
    """The few benchmark passages against all documents, once for each folder as long as its table is there."""
    key = (s.sparkContext.applicationId, d)
    if key not in _golds or not there(s, _golds[key]):
        _golds[key] = staged(_gold(s, d), "gold")
    return _golds[key]


#: Bytes of benchmark passages that are sent to the tasks, at most.
PASSAGES = 32 << 20


def _gold(s: SparkSession, d: str, most: int = PASSAGES) -> DataFrame:
    """A stated query set is looked for in one reading of each document; one above ``most`` bytes by a join."""
    docs, items = table(s, d, "documents").select(F.col("lang").alias("domain"), "doc_id", F.col("text").alias("t")), table(s, d, "benchmark")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > most:
        return docs.join(items, F.expr("contains(t, text)")).select("domain", F.col("item_id").alias("query_id"), "doc_id").distinct()
    few = items.where("text IS NOT NULL").select("item_id", F.encode("text", "UTF-8").alias("raw")).toArrow()
    texts, ids = [bytes(x) for x in few["raw"].to_pylist()], pa.concat_arrays(few["item_id"].chunks) if few.num_rows else pa.array([], few["item_id"].type)
    out = StructType([docs.schema["domain"], StructField("query_id", items.schema["item_id"].dataType), docs.schema["doc_id"]])
    return docs.mapInArrow(lambda b: contained_batches(b, texts, ids), out).distinct()


_indexes: dict[tuple[str, str, str], Index] = {}


def index(s: SparkSession, d: str, tokens: str = TOKENS) -> Index:
    """One stored index for each folder and tokenizer, as long as its tables are there."""
    key = (s.sparkContext.applicationId, d, tokens)
    if key not in _indexes or not all(there(s, t) for t in (_indexes[key].rows, *_indexes[key].kept.values())):
        _indexes[key] = build(corpus(s, d), tokens).stored()
    return _indexes[key]


def listed(s: SparkSession, d: str, how: Weighting | None = None, depth: int = DEPTH, ix: Index | None = None) -> DataFrame:
    return search(ix or index(s, d), asked(s, d), how, depth, TOKENS, FORM)


def listed_all(s: SparkSession, d: str, hows: list[Weighting]) -> list[DataFrame]:
    """The run of each weighting, written together after one pass over the documents."""
    every = staged(searches(index(s, d), asked(s, d), hows, DEPTH, TOKENS, FORM), "runs")
    return [every.where(F.col("how") == k).drop("how") for k in range(len(hows))]


def shown(run: DataFrame) -> DataFrame:
    return run.select(*LIST, F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def scored(s: SparkSession, d: str, how: Weighting | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    run, right = staged(listed(s, d, how), "run"), gold(s, d)
    return run, right, evaluate.per_query(run, right)


# -- text

def _token_query(name: str, tokens: Callable[[Column], Column], sql_tokens: str) -> None:
    query(name, O.query([O.CORPUS], f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {sql_tokens} AS t FROM corpus) WHERE len(t) > 0"))(
        lambda s, d: corpus(s, d).select("doc_id", tokens(F.col("text")).alias("t")).where("size(t) > 0").select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.concat_ws(" ", "t").cast("binary")).alias("tokens"))
    )


_SIMPLE_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_token_query("tokenize_simple", text.simple, _SIMPLE_SQL)
_token_query("tokenize_nohtml_stop", text.TOKENIZERS["nohtml_stop"], f"list_filter({_SIMPLE_SQL}, lambda x: NOT list_contains([{O._list([*text.HTML_WORDS, *text.ENGLISH_LONG])}], x))")
_token_query("tokenize_min_length", text.tokenizer(min_length=2), f"list_filter({_SIMPLE_SQL}, lambda x: len(x) >= 2)")
_token_query("tokenize_nohtml", text.TOKENIZERS["nohtml"], f"list_filter({_SIMPLE_SQL}, lambda x: NOT list_contains([{O._list(text.HTML_WORDS)}], x))")
_token_query("tokenize_lucene_nostem", text.english, rf"list_filter(regexp_extract_all(regexp_replace(lower(text), '''s\b', '', 'g'), '[a-z0-9]+'), lambda x: NOT list_contains([{O.SHORT}], x))")


@query("tokenize_lucene")
def _(s, d):
    tokens = with_stems(tokens_of(corpus(s, d), "lucene_like").where("term IS NOT NULL"))
    return tokens.groupBy("domain", "doc_id", "term").agg(F.count("*").alias("tf"))


_PAGES = "SELECT page_id, md5({x}) AS form, len({x}) AS n_chars FROM pages"
for _form in ("raw", "stripped", "title", "title_weighted"):
    query(f"query_form_{_form}", _PAGES.format(x=O.form(_form, "coalesce(html, '')")))(
        lambda s, d, f=_form: table(s, d, "pages").select("page_id", text.FORMS[f](F.col("html")).alias("x")).select("page_id", F.md5(F.col("x").cast("binary")).alias("form"), F.length("x").cast("long").alias("n_chars"))
    )


@query("strip_entities_first", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '&(quot|amp|lt|gt|nbsp|apos|#[0-9]+);', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS form FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", F.md5(text.stripped_entities_first(F.col("html")).cast("binary")).alias("form"))


@query("title_body_ratio", "SELECT quantile_cont(len(split_part(html, '<p>', 1))::DOUBLE / len(html), 0.5) AS ratio, count(*) AS pages FROM pages WHERE len(html) > 0")
def _(s, d):
    t = table(s, d, "pages").where("length(html) > 0").select((F.length(text.title(F.col("html"))) / F.length("html")).alias("r"))
    return t.agg(F.percentile("r", 0.5).alias("ratio"), F.count("*").alias("pages"))


@query("content_key", O.query([O.CORPUS], f"SELECT doc_id, {O.KEY} AS key, sha1(text) AS raw FROM corpus"))
def _(s, d):
    return corpus(s, d).select("doc_id", text.content_key(F.col("text")).alias("key"), text.content_hash(F.col("text")).alias("raw"))


@query("word_count", O.query([O.CORPUS], r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS n FROM corpus"))
def _(s, d):
    return corpus(s, d).select("doc_id", text.word_count(F.col("text")).cast("long").alias("n"))


@query("year_mention", r"SELECT 'documents' AS source, count(*) FILTER (regexp_matches(coalesce(text, ''), '\b(19|20)\d{2}\b')) AS n FROM documents UNION ALL SELECT 'pages', count(*) FILTER (regexp_matches(coalesce(html, ''), '\b(19|20)\d{2}\b')) FROM pages")
def _(s, d):
    one = lambda name, c: table(s, d, name).agg(F.count_if(text.has_year(F.col(c))).alias("n")).select(F.lit(name).alias("source"), "n")
    return one("documents", "text").union(one("pages", "html"))


@query("html_share", f"SELECT source, round(avg(h), 6) AS html, round(sum(m) / sum(n), 6) AS markup FROM (SELECT 'documents' AS source, regexp_matches(text, '<[^>]+>')::INT AS h, len(list_filter({_SIMPLE_SQL}, lambda x: list_contains([{O.MARKUP}], x))) AS m, len({_SIMPLE_SQL}) AS n FROM (SELECT coalesce(text, '') AS text FROM documents) UNION ALL SELECT 'pages', regexp_matches(text, '<[^>]+>')::INT, len(list_filter({_SIMPLE_SQL}, lambda x: list_contains([{O.MARKUP}], x))), len({_SIMPLE_SQL}) FROM (SELECT coalesce(html, '') AS text FROM pages)) GROUP BY ALL")
def _(s, d):
    def one(name, c):
        tokens = text.simple(F.col(c))
        return table(s, d, name).select(text.has_tag(F.col(c)).cast("int").alias("h"), tokens.alias("t")).select("h", text.markup_words(F.col("t")).alias("m"), F.size("t").alias("n")).agg(F.avg("h").alias("h"), F.try_divide(F.sum("m"), F.sum("n")).alias("m")).select(F.lit(name).alias("source"), F.round("h", 6).alias("html"), F.round("m", 6).alias("markup"))

    return one("documents", "text").union(one("pages", "html"))


@query("id_shape", "SELECT CASE WHEN regexp_matches(id, '^[^/]+/[0-9]+_[0-9a-f]{16}_[0-9]+\\.txt$') THEN 'long' WHEN regexp_matches(id, '^[^/]+/[0-9a-f]{8}_[0-9]+\\.txt$') THEN 'short' ELSE 'other' END AS shape, count(*) AS n FROM (SELECT lang || '/' || CASE doc_id % 3 WHEN 0 THEN substr(md5(doc_id::VARCHAR), 1, 8) || '_1.txt' WHEN 1 THEN doc_id || '_' || substr(md5(doc_id::VARCHAR), 1, 16) || '_2.txt' ELSE doc_id::VARCHAR END AS id FROM documents) GROUP BY ALL")
def _(s, d):
    own = F.md5(F.col("doc_id").cast("string").cast("binary"))
    form = F.when(F.col("doc_id") % 3 == 0, F.concat(F.substring(own, 1, 8), F.lit("_1.txt"))).when(F.col("doc_id") % 3 == 1, F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.substring(own, 1, 16), F.lit("_2.txt"))).otherwise(F.col("doc_id").cast("string"))
    return table(s, d, "documents").select(F.concat("lang", F.lit("/"), form).alias("id")).groupBy(text.id_shape(F.col("id")).alias("shape")).agg(F.count("*").alias("n"))


# -- index

@query("term_frequency", O.query(O.base(), "SELECT domain, doc_id, term, tf FROM tf"))
def _(s, d):
    return index(s, d).postings.select("domain", "doc_id", "term", "tf")


@query("doc_length_stats", O.query(O.base(), "SELECT domain, n, round(avgdl, 6) AS avgdl, total FROM st"))
def _(s, d):
    return rounded(index(s, d).domains(), "avgdl")


@query("document_frequency", O.query(O.base(), "SELECT domain, term, df, cf FROM lex"))
def _(s, d):
    return index(s, d).lexicon()


@query("collection_probability", O.query(O.base(), "SELECT domain, term, cf, round(greatest(cf / total, 1e-12), 12) AS p FROM lex JOIN st USING (domain)"))
def _(s, d):
    return index(s, d).probabilities().withColumn("p", F.round("p", 12))


_SELECTED = O.STOP["nohtml_stop"].removeprefix("WHERE ")


@query("term_selection_ratio", O.query(O.base("simple"), f"SELECT domain, sum(cf)::BIGINT AS tokens, count(*) AS types, sum(cf) FILTER ({_SELECTED})::BIGINT AS kept_tokens, count(*) FILTER ({_SELECTED}) AS kept_types, round(sum(cf) FILTER ({_SELECTED}) / sum(cf), 6) AS token_share FROM lex GROUP BY ALL"))
def _(s, d):
    kept = ~F.col("term").isin(*text.HTML_WORDS, *text.ENGLISH_LONG)
    mine = F.sum(F.when(kept, F.col("cf"))).cast("long")
    return index(s, d, "simple").lexicon().groupBy("domain").agg(F.sum("cf").cast("long").alias("tokens"), F.count("*").alias("types"), mine.alias("kept_tokens"), F.count_if(kept).alias("kept_types"), F.round(mine / F.sum("cf"), 6).alias("token_share"))


for _name, _test, _n in (("kept", _SELECTED, 200), ("dropped", f"NOT ({_SELECTED})", 40)):

    @query(f"top_terms_{_name}", O.query(O.base("simple"), f"SELECT term, sum(cf)::BIGINT AS cf FROM lex WHERE {_test} GROUP BY ALL ORDER BY cf DESC, term LIMIT {_n}"))
    def _(s, d, drop=_name == "dropped", n=_n):
        stop = F.col("term").isin(*text.HTML_WORDS, *text.ENGLISH_LONG)
        return index(s, d, "simple").lexicon().where(stop if drop else ~stop).groupBy("term").agg(F.sum("cf").cast("long").alias("cf")).orderBy(F.col("cf").desc(), "term").limit(n)


@query("index_stats", O.query(O.base(), "SELECT domain, n, vocabulary, postings, total AS tokens, round(postings / (n * vocabulary), 9) AS density, round(postings / n, 6) AS postings_per_doc, 12 * postings AS bytes FROM st JOIN (SELECT domain, count(*) AS vocabulary, sum(df)::BIGINT AS postings FROM lex GROUP BY ALL) USING (domain)"))
def _(s, d):
    ix = index(s, d)
    terms = ix.lexicon().groupBy("domain").agg(F.count("*").alias("vocabulary"), F.sum("df").alias("postings"))
    return ix.domains().join(terms, "domain").select("domain", "n", "vocabulary", "postings", F.col("total").alias("tokens"), F.round(F.col("postings") / (F.col("n") * F.col("vocabulary")), 9).alias("density"), F.round(F.col("postings") / F.col("n"), 6).alias("postings_per_doc"), (12 * F.col("postings")).alias("bytes"))


@query("heaps_slope", O.query(O.base(), "SELECT round(regr_slope(ln(v), ln(n)), 6) AS slope FROM (SELECT domain, count(*) AS v FROM lex GROUP BY ALL) JOIN st USING (domain)"))
def _(s, d):
    ix = index(s, d)
    return ix.lexicon().groupBy("domain").agg(F.count("*").alias("v")).join(ix.domains(), "domain").agg(F.round(F.regr_slope(F.log("v"), F.log("n")), 6).alias("slope"))


@query("posting_lookup", O.query(O.base(), "SELECT domain, term, df, doc_id, tf FROM (SELECT domain, term, df FROM lex QUALIFY row_number() OVER (PARTITION BY domain ORDER BY df DESC, term) IN (1, 1 + count(*) OVER (PARTITION BY domain) // 100, 1 + count(*) OVER (PARTITION BY domain) // 2, count(*) OVER (PARTITION BY domain))) JOIN tf USING (domain, term)"))
def _(s, d):
    ix = index(s, d)
    own = Window.partitionBy("domain")
    n = F.col("_n")
    picked = ix.lexicon().withColumn("_n", F.count("*").over(own)).withColumn("_k", F.row_number().over(own.orderBy(F.col("df").desc(), "term"))).where((F.col("_k") == 1) | (F.col("_k") == 1 + F.floor(n / 100)) | (F.col("_k") == 1 + F.floor(n / 2)) | (F.col("_k") == n))
    return picked.select("domain", "term", "df").join(ix.postings, ["domain", "term"]).select("domain", "term", "df", "doc_id", "tf")


@query("corpus_touched_share", O.query(O.base(), "SELECT domain, round(min(x), 6) AS low, round(quantile_cont(x, 0.5), 6) AS middle, round(max(x), 6) AS high FROM (SELECT q.domain, q.query_id, count(DISTINCT t.doc_id) / any_value(n) AS x FROM qt q JOIN tf t USING (domain, term) JOIN st ON st.domain = q.domain GROUP BY ALL) GROUP BY ALL"))
def _(s, d):
    t = touched(index(s, d), asked(s, d), TOKENS, FORM)
    return t.groupBy("domain").agg(F.round(F.min("share"), 6).alias("low"), F.round(F.percentile("share", 0.5), 6).alias("middle"), F.round(F.max("share"), 6).alias("high"))


# -- models

_MODELS = {
    "search_boolean_and": {"model": "boolean_and"}, "search_boolean_or": {"model": "boolean_or"}, "search_tf": {"model": "tf"}, "search_tfidf": {"model": "tfidf"}, "search_bm25_default": {}, "search_bm25_tuned": {"k1": 2.0, "b": 0.9}, "search_qlm": {"model": "qlm"},
    "bm25_no_idf": {"use_idf": False}, "bm25_b0": {"b": 0.0}, "bm25_b1": {"b": 1.0}, "bm25_k1_large": {"k1": 1e6}, "bm25_k1_tiny": {"k1": 1e-6}, "tfidf_no_idf": {"model": "tfidf", "use_idf": False},
}
for _name, _how in _MODELS.items():
    query(_name, O.query(O.base() + O.run(**_how), O.shown()))(lambda s, d, how=_how: shown(listed(s, d, Weighting(**how))))


@query("search_simple_raw", O.query(O.base("simple", "raw") + O.run(), O.shown()))
def _(s, d):
    return shown(search(index(s, d, "simple"), asked(s, d), Weighting(), DEPTH, "simple", "raw"))


@query("search_stemmed")
def _(s, d):
    return shown(search(index(s, d, "lucene_like"), asked(s, d), Weighting(), DEPTH, "lucene_like", FORM))


def _sweep(name: str, grid: list[dict], keys: list[str]) -> None:
    tables, selects = O.base(), []
    for k, how in enumerate(grid):
        tables += O.run(f"r{k}", **how) + O.metrics(f"r{k}", f"m{k}") + O.domains(f"m{k}", f"r{k}", f"d{k}")
        values = ", ".join(f"{how[x]}::DOUBLE AS {x}" for x in keys)
        selects.append(f"SELECT {values}, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(ceiling), 6) AS ceiling FROM d{k}")

    @query(name, O.query(tables, " UNION ALL ".join(selects)))
    def _(s, d):
        right, out = gold(s, d), None
        for how, run in zip(grid, listed_all(s, d, [Weighting(**how) for how in grid]), strict=True):
            macro = evaluate.macro(evaluate.by_domain(evaluate.per_query(run, right), right, run))
            row = rounded(macro, "ndcg", "recall", "ceiling").select(*[F.lit(float(how[x])).alias(x) for x in keys], "ndcg", "recall", "ceiling")
            out = row if out is None else out.union(row)
        return out


_sweep("mu_sweep", [{"model": "qlm", "mu": float(m)} for m in (500, 1000, 2000, 4000)], ["mu"])
_sweep("k1_b_grid", [{"k1": k, "b": b} for k in (0.9, 1.5, 2.0) for b in (0.4, 0.75, 0.9)], ["k1", "b"])

# -- metrics

_SCORED = O.base() + O.run() + O.metrics()
for _name, _columns in {"ndcg_per_query": ["ndcg"], "precision_at_10": ["precision"], "recall_at_100": ["recall"], "f1_at_10": ["f1", "recall_at_cut"], "average_precision": ["map"], "rerank_ceiling": ["ceiling"]}.items():
    query(_name, O.query(_SCORED, f"SELECT domain, query_id, {', '.join(f'round({c}, 6) AS {c}' for c in _columns)} FROM scores"))(lambda s, d, c=_columns: rounded(scored(s, d)[2].select(*LIST, *c), *c))


@query("evaluate_by_domain", O.query(_SCORED + O.domains(), f"SELECT domain, n_topics, n_gold_queries, {', '.join(f'round({m}, 6) AS {m}' for m in O.METRICS)} FROM doms"))
def _(s, d):
    run, right, scores = scored(s, d)
    return rounded(evaluate.by_domain(scores, right, run), *O.METRICS).select("domain", "n_topics", "n_gold_queries", *O.METRICS)


@query("macro_scores", O.query(_SCORED + O.domains(), f"SELECT count(*) AS n_domains, sum(n_topics)::BIGINT AS n_topics, {', '.join(f'round(avg({m}), 6) AS {m}' for m in O.METRICS)} FROM doms"))
def _(s, d):
    run, right, scores = scored(s, d)
    return rounded(evaluate.macro(evaluate.by_domain(scores, right, run)), *O.METRICS)


@query("honest_vs_reported", O.query(_SCORED + O.domains(), "SELECT round(avg(ndcg), 6) AS reported, round(avg(ndcg * n_topics / n_gold_queries), 6) AS honest FROM doms WHERE n_gold_queries > 0"))
def _(s, d):
    run, right, scores = scored(s, d)
    return rounded(evaluate.honest(evaluate.by_domain(scores, right, run)), "reported", "honest")


_CURVE = [f"c{k} AS (SELECT domain, query_id, count(*) FILTER (rank <= {k} AND rel = 1) AS found FROM scores_j GROUP BY ALL)" for k in DEPTHS]
_CURVE_SQL = " UNION ALL ".join(f"SELECT {k}::BIGINT AS depth, round(avg(x), 6) AS {{m}} FROM (SELECT domain, avg({{e}}) AS x FROM c{k} JOIN goldn USING (domain, query_id) GROUP BY ALL)" for k in DEPTHS)
for _name, _m, _e in (("recall_depth_curve", "recall", "found / n_gold"), ("ceiling_depth_curve", "ceiling", f"coalesce({O._ideal('least(found, 10)')}, 0) / {O._ideal('least(n_gold, 10)')}")):

    @query(_name, O.query(_SCORED + _CURVE, _CURVE_SQL.format(m=_m, e=_e)))
    def _(s, d, m=_m):
        return evaluate.depth_curve(listed(s, d), gold(s, d), DEPTHS).select(F.col("depth").cast("long").alias("depth"), F.round(m, 6).alias(m))


@query("failure_breakdown", O.query(_SCORED, "SELECT CASE WHEN ndcg > 0 THEN 'scored' WHEN found > 0 THEN 'recoverable' ELSE 'unreachable' END AS outcome, count(*) AS queries FROM scores GROUP BY ALL"))
def _(s, d):
    return evaluate.breakdown(scored(s, d)[2])


@query("explain_queries", O.query(_SCORED, f"SELECT domain, query_id, round(ndcg, 6) AS ndcg, n_gold, found, best_rank, substr({O.stripped('text')}, 1, 60) AS text FROM scores JOIN queries USING (domain, query_id)"))
def _(s, d):
    _, _, scores = scored(s, d)
    text_of = asked(s, d).select(*LIST, F.substring(text.stripped(F.col("text")), 1, 60).alias("text"))
    return scores.join(text_of, LIST).select(*LIST, F.round("ndcg", 6).alias("ndcg"), F.col("n_gold").cast("long").alias("n_gold"), F.col("found").cast("long").alias("found"), F.col("best_rank").cast("long").alias("best_rank"), "text")


@query("best_worst_cases", O.query(_SCORED, " UNION ALL ".join(f"SELECT * FROM (SELECT domain, query_id, round(ndcg, 6) AS ndcg, '{x}' AS side FROM scores ORDER BY round(scores.ndcg, 9) {o}, query_id, domain LIMIT 5)" for x, o in (("best", "DESC"), ("worst", "ASC")))))
def _(s, d):
    return rounded(evaluate.cases(scored(s, d)[2]), "ndcg")


@query("lexical_reach", O.query(O.base(), "SELECT count(*) AS pairs, count(*) FILTER (shared) AS reached FROM (SELECT g.domain, g.query_id, g.doc_id, bool_or(t.term IS NOT NULL) AS shared FROM gold g LEFT JOIN qt q USING (domain, query_id) LEFT JOIN tf t ON t.domain = g.domain AND t.doc_id = g.doc_id AND t.term = q.term GROUP BY ALL)"))
def _(s, d):
    pairs = gold(s, d)
    terms = query_terms(asked(s, d), TOKENS, FORM).groupBy(*LIST).agg(F.collect_set("term").alias("q"))
    docs = corpus(s, d).select("domain", "doc_id", text.TOKENIZERS[TOKENS](F.col("text")).alias("t"))
    both = pairs.join(terms, LIST, "left").join(docs, ["domain", "doc_id"])
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.coalesce(F.arrays_overlap("q", "t"), F.lit(False))).alias("reached"))


@query("tie_diversity", O.query(O.base() + O.run(), "SELECT domain, round(avg(x), 6) AS distinct_scores FROM (SELECT domain, query_id, count(DISTINCT round(score, 10)) AS x FROM run WHERE rank <= 10 GROUP BY ALL) GROUP BY ALL"))
def _(s, d):
    top = listed(s, d).where("rank <= 10").groupBy(*LIST).agg(F.count_distinct(F.round("score", 10)).alias("x"))
    return top.groupBy("domain").agg(F.round(F.avg("x"), 6).alias("distinct_scores"))


# -- dedup

@query("duplicate_groups", O.query([O.CORPUS, *O.GROUPS], "SELECT domain, doc_id, canonical_id FROM groups"))
def _(s, d):
    return runs.duplicate_groups(corpus(s, d))


@query("duplicate_profile", O.query([O.CORPUS, *O.GROUPS], "SELECT domain, count(*) AS docs, count(DISTINCT key) AS texts, round(1 - count(DISTINCT key) / count(*), 6) AS duplicate_share, max(n) AS largest, count(*) FILTER (n > 1) AS in_groups FROM (SELECT *, count(*) OVER (PARTITION BY domain, key) AS n FROM keyed) GROUP BY ALL"))
def _(s, d):
    sizes = corpus(s, d).select("domain", text.content_key(F.col("text")).alias("key")).groupBy("domain", "key").agg(F.count("*").alias("n"))
    return sizes.groupBy("domain").agg(F.sum("n").alias("docs"), F.count("*").alias("texts"), F.round(1 - F.count("*") / F.sum("n"), 6).alias("duplicate_share"), F.max("n").alias("largest"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_groups"))


@query("duplicate_group_histogram", O.query([O.CORPUS, *O.GROUPS], "SELECT n AS size, count(*) AS groups FROM (SELECT domain, key, count(*) AS n FROM keyed GROUP BY ALL) GROUP BY ALL"))
def _(s, d):
    sizes = corpus(s, d).select("domain", text.content_key(F.col("text")).alias("key")).groupBy("domain", "key").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))


for _name, _expand, _limit in (("dedup_collapse", 1, None), ("dedup_expand2", 2, None), ("dedup_expand3", 3, None), ("dedup_limit", 2, 10)):
    query(_name, O.query(O.base() + O.run() + O.dedup("run", "cut", _expand, _limit), O.shown("cut")))(lambda s, d, e=_expand, n=_limit: shown(runs.dedup(listed(s, d), runs.duplicate_groups(corpus(s, d)), e, n)))


_CANONICAL = [*O.base(), *O.run(), *O.GROUPS, "canon AS (SELECT r.*, coalesce(canonical_id, doc_id) AS c FROM run r LEFT JOIN groups USING (domain, doc_id))"]


def _waste(s: SparkSession, d: str) -> DataFrame:
    lists = runs.with_canonical(listed(s, d), runs.duplicate_groups(corpus(s, d)))
    per_list = lists.groupBy(*LIST).agg(F.count("*").alias("n"), F.count_distinct("canonical_id").alias("texts"))
    return per_list.groupBy("domain").agg(F.sum("n").alias("candidates"), F.sum("texts").alias("texts"))


@query("candidate_waste", O.query(_CANONICAL, "SELECT domain, sum(n)::BIGINT AS candidates, sum(t)::BIGINT AS texts, round(1 - sum(t) / sum(n), 6) AS waste FROM (SELECT domain, query_id, count(*) AS n, count(DISTINCT c) AS t FROM canon GROUP BY ALL) GROUP BY ALL"))
def _(s, d):
    return _waste(s, d).withColumn("waste", F.round(1 - F.col("texts") / F.col("candidates"), 6))


@query("depth_needed", O.query(_CANONICAL, "SELECT max(x)::BIGINT AS depth FROM (SELECT ceil(1000 / (sum(t) / sum(n))) AS x FROM (SELECT domain, query_id, count(*) AS n, count(DISTINCT c) AS t FROM canon GROUP BY ALL) GROUP BY domain)"))
def _(s, d):
    return _waste(s, d).agg(F.max(F.ceil(1000 / (F.col("texts") / F.col("candidates")))).alias("depth"))


@query("naive_dedup_loss", O.query([O.CORPUS, O.GOLD, *O.GROUPS], "SELECT count(*) AS gold, count(*) FILTER (canonical_id IS NOT NULL AND canonical_id <> doc_id) AS lost FROM gold LEFT JOIN groups USING (domain, doc_id)"))
def _(s, d):
    pairs = gold(s, d).join(runs.duplicate_groups(corpus(s, d)), ["domain", "doc_id"], "left")
    return pairs.agg(F.count("*").alias("gold"), F.count_if(F.coalesce(F.col("canonical_id") != F.col("doc_id"), F.lit(False))).alias("lost"))


@query("gold_with_twin", O.query(_CANONICAL, "SELECT count(*) AS gold_in_lists, count(*) FILTER (twins > 1) AS with_twin FROM (SELECT *, count(*) OVER (PARTITION BY domain, query_id, c) AS twins FROM canon) JOIN gold USING (domain, query_id, doc_id)"))
def _(s, d):
    lists = runs.with_canonical(listed(s, d), runs.duplicate_groups(corpus(s, d))).withColumn("twins", F.count("*").over(Window.partitionBy(*LIST, "canonical_id")))
    return lists.join(gold(s, d), [*LIST, "doc_id"]).agg(F.count("*").alias("gold_in_lists"), F.count_if(F.col("twins") > 1).alias("with_twin"))


# -- rerank, fuse, dense

_EXTERNAL = "ext AS (SELECT domain, query_id, doc_id, (doc_id * 7919 % 1000)::DOUBLE / 1000 AS score FROM run WHERE {where})"


def _reranked(tables: list[str]) -> str:
    own = "SELECT domain, query_id, doc_id, score, 0 AS b, -score AS o FROM ext UNION ALL SELECT r.domain, r.query_id, r.doc_id, r.score, 1, r.rank FROM run r ANTI JOIN ext e ON e.domain = r.domain AND e.query_id = r.query_id AND e.doc_id = r.doc_id"
    return O.query([*tables, O.ranked("re", own, "b, o, doc_id")], O.shown("re"))


def _external(run: DataFrame, where: str) -> DataFrame:
    return run.where(where).select(*LIST, "doc_id", ((F.col("doc_id") * 7919 % 1000).cast("double") / 1000).alias("score"))


for _name, _where in (("rerank_external", "rank <= 100"), ("rerank_partial_tail", "rank <= 20 AND query_id % 2 = 0")):

    @query(_name, _reranked([*O.base(), *O.run(), _EXTERNAL.format(where=_where)]))
    def _(s, d, where=_where):
        run = staged(listed(s, d), "run")
        return shown(runs.rerank(run, _external(run, where)))


@query("rerank_scorer")
def _(s, d):
    run = staged(listed(s, d, depth=20), "run")
    return shown(runs.rerank(run, neural.score_pairs(run, asked(s, d), corpus(s, d))))


@query("retrieve_external", O.query([*O.base(), *O.run(), _EXTERNAL.format(where="rank <= 50"), O.ranked("ex", "SELECT * FROM ext", "score DESC, doc_id", 20)], O.shown("ex")))
def _(s, d):
    return shown(runs.from_scores(_external(listed(s, d), "rank <= 50"), 20))


_TWO = [*O.base(), *O.run("a"), *O.run("b", model="tfidf")]


def _two(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a, b = listed_all(s, d, [Weighting(), Weighting("tfidf")])
    return a, b


@query("rrf_bm25_tfidf", O.query([*_TWO, *O.rrf(["a", "b"], "f", 60, 100)], O.shown("f")))
def _(s, d):
    return shown(runs.rrf(list(_two(s, d)), 60, 100))


@query("rrf_k_sweep", O.query([*_TWO, *[t for k in (10, 30, 60, 120) for t in O.rrf(["a", "b"], f"f{k}", k, 10)]], " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, domain, query_id, rank, doc_id FROM f{k}" for k in (10, 30, 60, 120))))
def _(s, d):
    both, out = list(_two(s, d)), None
    for k in (10, 30, 60, 120):
        one = runs.rrf(both, k, 10).select(F.lit(k).cast("long").alias("k"), *LIST, F.col("rank").cast("long").alias("rank"), "doc_id")
        out = one if out is None else out.union(one)
    return out


@query("union_ceiling", O.query([*_TWO, O.ranked("u", "SELECT domain, query_id, doc_id, arg_min(score, (src, rank)) AS score, min((src, rank)) AS o FROM (SELECT 0 AS src, * FROM a UNION ALL SELECT 1, * FROM b) GROUP BY ALL", "o"), *O.metrics("u")], "SELECT domain, query_id, n_returned, round(ceiling, 6) AS ceiling FROM scores"))
def _(s, d):
    scores = evaluate.per_query(runs.union(*_two(s, d)), gold(s, d))
    return rounded(scores.select(*LIST, "n_returned", "ceiling"), "ceiling")


@query("coverage_overlap", O.query(_TWO, "SELECT CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'first' WHEN b.doc_id IS NOT NULL THEN 'second' ELSE 'neither' END AS side, count(*) AS gold FROM gold g LEFT JOIN a ON a.domain = g.domain AND a.query_id = g.query_id AND a.doc_id = g.doc_id LEFT JOIN b ON b.domain = g.domain AND b.query_id = g.query_id AND b.doc_id = g.doc_id GROUP BY ALL"))
def _(s, d):
    a, b = _two(s, d)
    key = [*LIST, "doc_id"]
    both = gold(s, d).join(a.select(*key, F.lit(True).alias("a")), key, "left").join(b.select(*key, F.lit(True).alias("b")), key, "left")
    side = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first").when(F.col("b"), "second").otherwise("neither")
    return both.groupBy(side.alias("side")).agg(F.count("*").alias("gold"))


_DENSE = [
    f"v AS (SELECT vec_id, label, {O.UNIT.format(v='embedding')} AS u FROM embeddings)",
    O.ranked("den", "SELECT 'all' AS domain, q.vec_id AS query_id, d.vec_id AS doc_id, list_dot_product(q.u, d.u) AS score FROM v q, v d WHERE q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id", "round(score, 9) DESC, doc_id", 10),
]


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.lit("all").alias("domain"), "vec_id", F.col("embedding").alias("v"), "label")


def _dense(s: SparkSession, d: str) -> DataFrame:
    v = _vectors(s, d)
    return dense(v.withColumnRenamed("vec_id", "doc_id"), v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), 10, others=True)


@query("dense_cosine_topk", O.query(_DENSE, O.shown("den")))
def _(s, d):
    return shown(_dense(s, d))


@query("dense_label_agreement", O.query(_DENSE, "SELECT round(avg((a.label = b.label)::INT), 6) AS agreement FROM den JOIN v a ON a.vec_id = query_id JOIN v b ON b.vec_id = doc_id"))
def _(s, d):
    labels = table(s, d, "embeddings").select("vec_id", "label")
    both = _dense(s, d).join(labels.toDF("query_id", "a"), "query_id").join(labels.toDF("doc_id", "b"), "doc_id")
    return both.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("int")), 6).alias("agreement"))


@query("hybrid_rrf", O.query([*O.base(), *O.run("a"), *O.run("b", model="qlm"), *O.run("c", model="tfidf"), *O.rrf(["a", "b", "c"], "f", 60, 100)], "SELECT domain, query_id, rank, doc_id, round(1 / (60 + rank), 6) AS score FROM f"))
def _(s, d):
    lists = listed_all(s, d, [Weighting(m) for m in ("bm25", "qlm", "tfidf")])
    return shown(runs.fuse(lists[0], lists[1:], 60, 100))


# -- splits and comparisons

@query("split_hash", O.query([O.CORPUS, O.ASKED, *O.SPLIT], "SELECT domain, query_id, part FROM split"))
def _(s, d):
    return stats.split_by_hash(asked(s, d))


@query("split_numpy")
def _(s, d):
    ids: dict[str, list] = {}
    for r in asked(s, d).select(*LIST).orderBy(*LIST).collect():  # the queries of an evaluation
        ids.setdefault(r["domain"], []).append(r["query_id"])
    parts = stats.split_by_generator(ids)
    return s.createDataFrame([(k, q, p) for k, x in parts.items() for p, qs in x.items() for q in qs], "domain string, query_id long, part string")


@query("restrict_fit_check", O.query([*_SCORED, *O.SPLIT], " UNION ALL ".join(f"SELECT '{p}' AS part, domain, coalesce(n, 0) AS n_topics, round(coalesce(a, 0), 6) AS ndcg, round(coalesce(r, 0), 6) AS recall FROM (SELECT DISTINCT domain FROM split) LEFT JOIN (SELECT domain, count(*) AS n, avg(ndcg) AS a, avg(recall) AS r FROM scores JOIN split USING (domain, query_id) WHERE part = '{p}' GROUP BY ALL) USING (domain)" for p in ("fit", "check"))))
def _(s, d):
    scores, split = staged(scored(s, d)[2], "scores"), stats.split_by_hash(asked(s, d))
    one = lambda p: rounded(evaluate.restrict(scores, split, p), "ndcg", "recall").select(F.lit(p).alias("part"), "domain", "n_topics", "ndcg", "recall")
    return one("fit").union(one("check"))


@query("split_report", O.query([O.CORPUS, O.ASKED, O.GOLD, *O.SPLIT], rf"SELECT part, count(*) AS queries, round(quantile_cont(w, 0.5), 6) AS median_words, round(avg(g), 6) AS mean_gold, round(avg((g > 1)::INT), 6) AS share_multi, round(avg(y), 6) AS share_year FROM (SELECT part, len(list_filter(string_split_regex({O.stripped('text')}, '\s+'), lambda x: x <> ''))::DOUBLE AS w, coalesce(g, 0) AS g, regexp_matches(text, '\b(19|20)\d{{2}}\b')::INT AS y FROM split JOIN queries USING (domain, query_id) LEFT JOIN (SELECT domain, query_id, count(*) AS g FROM gold GROUP BY ALL) USING (domain, query_id)) GROUP BY ALL"))
def _(s, d):
    n = gold(s, d).groupBy(*LIST).agg(F.count("*").alias("g"))
    rows = stats.split_by_hash(asked(s, d)).join(asked(s, d), LIST).join(n, LIST, "left").withColumn("g", F.coalesce("g", F.lit(0)))
    rows = rows.select("part", text.word_count(text.stripped(F.col("text"))).alias("w"), "g", text.has_year(F.col("text")).cast("int").alias("y"))
    return rounded(rows.groupBy("part").agg(F.count("*").alias("queries"), F.percentile("w", 0.5).alias("median_words"), F.avg("g").alias("mean_gold"), F.avg((F.col("g") > 1).cast("int")).alias("share_multi"), F.avg("y").alias("share_year")), "median_words", "mean_gold", "share_multi", "share_year")


_PAIRED = [*_TWO, *O.metrics("a", "ma"), *O.metrics("b", "mb"), "diffs AS (SELECT domain, query_id, ma.ndcg - mb.ndcg AS diff FROM ma JOIN mb USING (domain, query_id))"]


def _diffs(s: SparkSession, d: str) -> DataFrame:
    a, b = _two(s, d)
    right = gold(s, d)
    return staged(stats.paired(evaluate.per_query(a, right), evaluate.per_query(b, right)), "diffs")


@query("paired_differences", O.query(_PAIRED, "SELECT domain, query_id, round(diff, 6) AS diff FROM diffs"))
def _(s, d):
    return rounded(_diffs(s, d), "diff")


@query("bootstrap_hash", O.query([
    *_PAIRED, "num AS (SELECT domain, diff, row_number() OVER (PARTITION BY domain ORDER BY query_id) - 1 AS k, count(*) OVER (PARTITION BY domain) AS n FROM diffs)",
    f"picked AS (SELECT draw, domain, {O.number('draw', 'domain', 'k')} % n AS k FROM num, range(1000) t(draw))",
    "means AS (SELECT draw, avg(m) AS m FROM (SELECT draw, domain, avg(diff) AS m FROM picked JOIN num USING (domain, k) GROUP BY ALL) GROUP BY ALL)",
    "bounds AS (SELECT coalesce(quantile_cont(m, 0.025), 0) AS low, coalesce(quantile_cont(m, 0.975), 0) AS high FROM means)",
], "SELECT round((SELECT coalesce(avg(m), 0) FROM (SELECT domain, avg(diff) AS m FROM diffs GROUP BY ALL)), 6) AS point, round(low, 6) AS low, round(high, 6) AS high, round(low, 9) > 0 OR round(high, 9) < 0 AS significant FROM bounds"))
def _(s, d):
    return rounded(stats.bootstrap_by_hash(_diffs(s, d), 1000), "point", "low", "high")


@query("bootstrap_numpy")
def _(s, d):
    by: dict[str, list[float]] = {}
    for r in _diffs(s, d).orderBy(*LIST).collect():  # the queries of an evaluation
        by.setdefault(r["domain"], []).append(r["diff"])
    out = stats.bootstrap_by_generator({k: np.array(v) for k, v in by.items()})
    return s.createDataFrame([out], "point double, low double, high double, significant boolean")


_SYSTEMS = {"bm25": {}, "bm25_tuned": {"k1": 2.0, "b": 0.9}, "qlm": {"model": "qlm"}, "tf": {"model": "tf"}}


@query("system_table", O.query(O.base() + [t for n, h in _SYSTEMS.items() for t in O.run(f"{n}_r", **h) + O.metrics(f"{n}_r", f"{n}_s") + O.domains(f"{n}_s", f"{n}_r", f"{n}_g")], "SELECT name, n_topics, round(ndcg, 6) AS ndcg, row_number() OVER (ORDER BY round(ndcg, 9) DESC, name) AS place FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, sum(n_topics)::BIGINT AS n_topics, avg(ndcg) AS ndcg FROM {n}_g" for n in _SYSTEMS) + ")"))
def _(s, d):
    right, out = gold(s, d), None
    for name, run in zip(_SYSTEMS, listed_all(s, d, [Weighting(**how) for how in _SYSTEMS.values()]), strict=True):
        row = evaluate.macro(evaluate.by_domain(evaluate.per_query(run, right), right, run)).select(F.lit(name).alias("name"), "n_topics", "ndcg")
        out = row if out is None else out.union(row)
    place = F.row_number().over(Window.orderBy(F.round("ndcg", 9).desc(), "name"))  # a row for each system
    return out.select("name", "n_topics", F.round("ndcg", 6).alias("ndcg"), place.cast("long").alias("place"))


@query("system_metrics", O.query(O.base() + [t for n, h in _SYSTEMS.items() for t in O.run(f"{n}_r", **h) + O.metrics(f"{n}_r", f"{n}_s") + O.domains(f"{n}_s", f"{n}_r", f"{n}_g")], f"SELECT name, n_topics, n_gold_queries, n_topics < n_gold_queries AS incomplete, {', '.join(f'round({m}, 6) AS {m}' for m in O.METRICS)}, row_number() OVER (ORDER BY round(ndcg, 9) DESC, name) AS place FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, sum(n_topics)::BIGINT AS n_topics, sum(n_gold_queries)::BIGINT AS n_gold_queries, {', '.join(f'avg({m}) AS {m}' for m in O.METRICS)} FROM {n}_g" for n in _SYSTEMS) + ")"))
def _(s, d):
    context = _context(s, d)
    context.indexes[TOKENS] = index(s, d)
    rows = pipeline.table(context, [{"name": n, "retrieve": {"kind": "sparse", **h}} for n, h in _SYSTEMS.items()], gold(s, d))
    return rounded(rows, *O.METRICS).select("name", "n_topics", "n_gold_queries", "incomplete", *O.METRICS, "place")


@query("recall_gain_by_depth", O.query(_SCORED + _CURVE, f"SELECT depth, round(recall - lag(recall) OVER (ORDER BY depth), 6) AS gain FROM ({_CURVE_SQL.format(m='recall', e='found / n_gold').replace('round(avg(x), 6)', 'avg(x)')})"))
def _(s, d):
    curve = evaluate.depth_curve(listed(s, d), gold(s, d), DEPTHS)  # a row for each depth
    return curve.select(F.col("depth").cast("long").alias("depth"), F.round(F.col("recall") - F.lag("recall").over(Window.orderBy("depth")), 6).alias("gain"))


@query("grid_spread", f"SELECT k1, round(max(ndcg) - min(ndcg), 6) AS spread, round(avg(ndcg), 6) AS mean, arg_max(b, (ndcg, -b)) AS best_b, arg_max(b, (ndcg, -b)) IN (0.4, 0.9) AS at_edge FROM ({SQL['k1_b_grid']}) GROUP BY ALL")
def _(s, d):
    grid = QUERIES["k1_b_grid"](s, d).groupBy("k1").agg((F.max("ndcg") - F.min("ndcg")).alias("spread"), F.avg("ndcg").alias("mean"), F.max_by("b", F.struct("ndcg", -F.col("b"))).alias("best_b"))
    return rounded(grid, "spread", "mean").withColumn("at_edge", F.col("best_b").isin(0.4, 0.9))


_RANKED = O.base() + O.SPLIT + [t for n, h in _SYSTEMS.items() for t in O.run(f"{n}_r", **h) + O.metrics(f"{n}_r", f"{n}_s")]
_PART_SQL = "SELECT '{n}' AS name, '{p}' AS part, (SELECT avg(coalesce(a, 0)) FROM (SELECT DISTINCT domain FROM split) LEFT JOIN (SELECT domain, avg(ndcg) AS a FROM {n}_s JOIN split USING (domain, query_id) WHERE part = '{p}' GROUP BY ALL) USING (domain)) AS ndcg"


@query("system_rank_by_part", O.query(_RANKED, "SELECT name, part, round(ndcg, 6) AS ndcg, rank() OVER (PARTITION BY part ORDER BY round(ndcg, 9) DESC) AS place FROM (" + " UNION ALL ".join(_PART_SQL.format(n=n, p=p) for n in _SYSTEMS for p in ("fit", "check")) + ")"))
def _(s, d):
    """Whether systems rank alike on both parts of a split."""
    right, split, out = gold(s, d), staged(stats.split_by_hash(asked(s, d)), "split"), None
    for name, run in zip(_SYSTEMS, listed_all(s, d, [Weighting(**how) for how in _SYSTEMS.values()]), strict=True):
        scores = staged(evaluate.per_query(run, right), "scores")
        for part in ("fit", "check"):
            row = evaluate.restrict(scores, split, part).agg(F.avg("ndcg").alias("ndcg")).select(F.lit(name).alias("name"), F.lit(part).alias("part"), "ndcg")
            out = row if out is None else out.union(row)
    place = F.rank().over(Window.partitionBy("part").orderBy(F.round("ndcg", 9).desc()))
    return out.select("name", "part", F.round("ndcg", 6).alias("ndcg"), place.cast("long").alias("place"))


@query("headroom_collected", O.query([*O.base(), *O.run(), *O.metrics(), *O.domains(), _EXTERNAL.format(where="rank <= 100"), O.ranked("re", "SELECT domain, query_id, doc_id, score FROM ext", "score DESC, doc_id"), *O.metrics("re", "rs"), *O.domains("rs", "re", "rd")], "SELECT round((r.n - b.n) / nullif(b.c - b.n, 0), 6) AS collected FROM (SELECT avg(ndcg) AS n, avg(ceiling) AS c FROM doms) b, (SELECT avg(ndcg) AS n FROM rd) r"))
def _(s, d):
    run, right, scores = scored(s, d)
    again = runs.rerank(run, _external(run, "rank <= 100"))
    before = evaluate.macro(evaluate.by_domain(scores, right, run)).select(F.col("ndcg").alias("b"), F.col("ceiling").alias("c"))
    after = evaluate.macro(evaluate.by_domain(evaluate.per_query(again, right), right, again)).select(F.col("ndcg").alias("a"))
    return before.join(after).select(F.round(F.try_divide(F.col("a") - F.col("b"), F.col("c") - F.col("b")), 6).alias("collected"))


@query("gold_consistency", O.query([O.CORPUS, O.ASKED, O.GOLD], "SELECT count(*) AS differing FROM (SELECT g.domain, g.query_id FROM gold g WHERE g.doc_id % 5 = 0 GROUP BY ALL)"))
def _(s, d):
    """Queries whose listed gold differs from their judgements, where every fifth document is left out of the lists."""
    from trawl.sources.readers import gold_consistency

    right = gold(s, d)
    lists = right.where("doc_id % 5 <> 0").groupBy(*LIST).agg(F.collect_list("doc_id").alias("gold_ids"))
    listed_gold = right.select(*LIST).distinct().join(lists, LIST, "left")
    return gold_consistency(listed_gold, right).agg(F.count("*").alias("differing"))


# -- systems and jobs

def _context(s: SparkSession, d: str) -> pipeline.Context:
    return pipeline.Context(s, corpus(s, d), asked(s, d))


_FUSED = {"retrieve": {"kind": "sparse", "k1": 2.0, "b": 0.9}, "dedup": {"kind": "content_hash", "expand": 2}, "fuse": {"kind": "rrf", "sources": [{"retrieve": {"kind": "sparse", "model": "qlm"}}], "depth": 50}}


@query("pipeline_retrieve_dedup_fuse", O.query([*O.base(), *O.run("a", k1=2.0, b=0.9), *O.dedup("a", "x", 2), *O.run("q", model="qlm"), *O.rrf(["x", "q"], "f", 60, 50)], "SELECT domain, query_id, rank, doc_id, round(1 / (60 + rank), 6) AS score FROM f"))
def _(s, d):
    return shown(pipeline.run(_context(s, d), _FUSED))


@query("trec_run_lines", O.query([*O.base(), *O.run()], "SELECT domain, query_id, rank, printf('%d Q0 %d %d %.6f tag', query_id, doc_id, rank, round(score, 6)) AS line FROM run WHERE rank <= 10"))
def _(s, d):
    return writers.trec_lines(listed(s, d, depth=10), "tag").withColumn("rank", F.col("rank").cast("long"))


@query("run_file_rows", O.query([*O.base(), *O.run()], "SELECT domain AS d, query_id AS q, string_agg(doc_id, ',' ORDER BY rank) AS i, string_agg(printf('%.6f', round(score, 6)), ',' ORDER BY rank) AS s FROM run GROUP BY ALL"))
def _(s, d):
    rows = writers.nested(listed(s, d))
    return rows.select("d", "q", F.concat_ws(",", F.transform("i", lambda x: x.cast("string"))).alias("i"), F.concat_ws(",", F.transform("s", lambda x: F.format_string("%.6f", x))).alias("s"))


@query("gpu_job_candidates", O.query([*O.base(), *O.run()], "SELECT domain, query_id, count(*) AS n, string_agg(doc_id, ',' ORDER BY rank) AS docs FROM run WHERE rank <= 20 GROUP BY ALL"))
def _(s, d):
    lists = listed(s, d, depth=20).groupBy(*LIST).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("x"))
    return lists.select(*LIST, "n", F.concat_ws(",", F.transform("x", lambda r: r["doc_id"].cast("string"))).alias("docs"))


@query("gpu_job_documents", O.query([*O.base(), *O.run()], "SELECT DISTINCT c.domain, c.doc_id, len(c.text) AS n_chars FROM corpus c SEMI JOIN (SELECT domain, doc_id FROM run WHERE rank <= 20) USING (domain, doc_id)"))
def _(s, d):
    needed = listed(s, d, depth=20).select("domain", "doc_id").distinct()
    return corpus(s, d).join(needed, ["domain", "doc_id"], "left_semi").select("domain", "doc_id", F.length("text").cast("long").alias("n_chars"))


# -- profiles

_QUANTILES = [0.01, 0.25, 0.5, 0.75, 0.95, 0.99]


@query("corpus_profile", O.query([O.CORPUS, *O.GROUPS], "SELECT domain, count(*) AS docs, count(DISTINCT sha1(text)) AS texts, " + ", ".join(f"round(quantile_cont(len(text)::DOUBLE, {q}), 6) AS p{int(q * 100)}" for q in _QUANTILES) + ", round(avg(len(text)), 6) AS mean, max(len(text)) AS longest FROM corpus GROUP BY ALL"))
def _(s, d):
    docs = corpus(s, d).select("domain", F.length("text").alias("n"), text.content_hash(F.col("text")).alias("h"))
    distinct = docs.select("domain", "h").distinct().groupBy("domain").agg(F.count("*").alias("texts"))
    p = F.percentile("n", F.array(*[F.lit(q) for q in _QUANTILES]))
    own = docs.groupBy("domain").agg(F.count("*").alias("docs"), p.alias("p"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").cast("long").alias("longest"))
    return own.join(distinct, "domain").select("domain", "docs", "texts", *[F.round(F.col("p")[i], 6).alias(f"p{int(q * 100)}") for i, q in enumerate(_QUANTILES)], "mean", "longest")


@query("gold_count_histogram", O.query([O.CORPUS, O.GOLD], "SELECT least(n, 10) AS gold, count(*) AS queries FROM (SELECT domain, query_id, count(*) AS n FROM gold GROUP BY ALL) GROUP BY ALL"))
def _(s, d):
    return gold(s, d).groupBy(*LIST).agg(F.count("*").alias("n")).groupBy(F.least("n", F.lit(10).cast("long")).alias("gold")).agg(F.count("*").alias("queries"))


@query("granularity_shares", "SELECT role, n, round(n / total, 6) AS share, round(sum(n) OVER (ORDER BY n DESC, role) / total, 6) AS cumulative FROM (SELECT role, count(*) AS n, sum(count(*)) OVER () AS total FROM conversations GROUP BY role)")
def _(s, d):
    """Shares and running shares of a label, as for the guidance's granularity."""
    n = table(s, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))  # a row for each label
    whole, running = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), "role").rowsBetween(Window.unboundedPreceding, 0)
    return n.select("role", "n", F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"), F.round(F.sum("n").over(running) / F.sum("n").over(whole), 6).alias("cumulative"))


@query("prefix_sample", "SELECT lang AS domain, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50")
def _(s, d):
    from trawl.sources.readers import prefix

    return prefix(corpus(s, d).withColumn("pos", F.col("doc_id")), 50).select("domain", "doc_id")
