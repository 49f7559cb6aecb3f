"""SQL that computes the same as the queries of ``catalogue``, for comparison on another engine."""

from __future__ import annotations

from trawl.functions.words import ENGLISH_LONG, ENGLISH_SHORT, HTML_WORDS, MARKUP_WORDS

DEPTH = 100
METRICS = ["ndcg", "precision", "recall", "recall_at_cut", "f1", "map", "ceiling"]


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


STOP = {"simple": "", "nohtml": f"WHERE term NOT IN ({_list(HTML_WORDS)})", "nohtml_stop": f"WHERE term NOT IN ({_list(sorted({*HTML_WORDS, *ENGLISH_LONG}))})"}


def stripped(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&(quot|amp|lt|gt|nbsp|apos|#[0-9]+);', ' ', 'g'), '\s+', ' ', 'g'))"


def form(name: str, x: str = "text") -> str:
    title = f"split_part({x}, '<p>', 1)"
    return {"raw": x, "stripped": stripped(x), "title": stripped(title), "title_weighted": stripped(f"repeat({title} || ' ', 3) || {x}")}[name]


CORPUS = "corpus AS (SELECT lang AS domain, doc_id, coalesce(text, '') AS text FROM documents)"
ASKED = "queries AS (SELECT domain, item_id AS query_id, text FROM benchmark, (SELECT DISTINCT domain FROM corpus))"
GOLD = "gold AS (SELECT DISTINCT domain, query_id, doc_id FROM (SELECT d.lang AS domain, b.item_id AS query_id, d.doc_id FROM documents d, benchmark b WHERE contains(d.text, b.text)))"


def words(x: str) -> str:
    return f"unnest(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


def base(tokenizer: str = "nohtml_stop", query_form: str = "title_weighted") -> list[str]:
    """Tables of an index and the terms of all queries."""
    stop = STOP[tokenizer]
    return [
        CORPUS, ASKED, GOLD,
        f"toks AS (SELECT * FROM (SELECT domain, doc_id, {words('text')} AS term FROM corpus) {stop})",
        "tf AS (SELECT domain, doc_id, term, count(*)::DOUBLE AS tf FROM toks GROUP BY ALL)",
        "dl AS (SELECT c.domain, c.doc_id, count(t.term) AS len FROM corpus c LEFT JOIN toks t ON c.domain = t.domain AND c.doc_id = t.doc_id GROUP BY ALL)",
        "st AS (SELECT domain, count(*) AS n, avg(len) AS avgdl, sum(len)::BIGINT AS total FROM dl GROUP BY ALL)",
        "lex AS (SELECT domain, term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY ALL)",
        f"qt AS (SELECT domain, query_id, term, count(*)::DOUBLE AS qtf FROM (SELECT domain, query_id, {words(form(query_form))} AS term FROM queries) {stop} GROUP BY ALL)",
    ]


def weight(model: str, k1: float, b: float, mu: float, use_idf: bool) -> tuple[str, str]:
    """Of a posting, and the idf."""
    idf = "1.0" if not use_idf else "ln(n / greatest(df, 1))" if model == "tfidf" else "ln(1 + (n - df + 0.5) / (df + 0.5))"
    return {
        "tf": "1 + ln(tf)", "tfidf": f"(1 + ln(tf)) * {idf}", "qlm": f"ln(1 + tf / ({mu} * greatest(cf / total, 1e-12)))",
        "bm25": f"{idf} * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * len / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END))",
    }.get(model, "1.0"), idf


def run(name: str = "run", model: str = "bm25", k1: float = 0.9, b: float = 0.4, mu: float = 2000.0, use_idf: bool = True, depth: int = DEPTH) -> list[str]:
    """Tables that end in the run ``name``."""
    w, idf = weight(model, k1, b, mu, use_idf)
    q = "1.0" if model.startswith("boolean") else f"(1 + ln(qtf)) * {idf}" if model == "tfidf" else "qtf"
    out = [f"{name}_k AS (SELECT domain, query_id, term, df, cf, n, avgdl, total, {q} AS q FROM qt JOIN lex USING (domain, term) JOIN st USING (domain))"]
    part, norm = f"q * ({w})", ""
    if model == "tfidf":
        out.append(f"{name}_d AS (SELECT domain, doc_id, sqrt(sum(({w}) * ({w}))) AS norm FROM tf JOIN lex USING (domain, term) JOIN st USING (domain) GROUP BY ALL)")
        out.append(f"{name}_q AS (SELECT domain, query_id, sqrt(sum(q * q)) AS qnorm FROM {name}_k GROUP BY ALL)")
        norm = f"JOIN {name}_d USING (domain, doc_id) JOIN {name}_q USING (domain, query_id)"
        part = f"q / CASE WHEN qnorm > 0 THEN qnorm ELSE 1 END * ({w}) / CASE WHEN norm > 0 THEN norm ELSE 1 END"
    out.append(f"{name}_h AS (SELECT domain, query_id, doc_id, sum({part}) AS score, any_value(len) AS len, count(*) AS matched FROM {name}_k JOIN tf USING (domain, term) JOIN dl USING (domain, doc_id) {norm} GROUP BY domain, query_id, doc_id)")
    if model == "boolean_and":
        out.append(f"{name}_t AS (SELECT domain, query_id, count(*) AS terms FROM qt GROUP BY ALL)")
        order, every = "doc_id", f"SELECT domain, query_id, doc_id, score FROM {name}_h JOIN {name}_t USING (domain, query_id) WHERE matched = terms"
    else:
        order = "round(score, 9) DESC, doc_id"
        bias = f"- qlen * ln(len + {mu})" if model == "qlm" else ""
        out.append(f"{name}_a AS (SELECT domain, query_id, sum(q) AS qlen FROM {name}_k GROUP BY ALL)")
        # every document of the domain, for a plain definition
        every = f"SELECT a.domain, a.query_id, dl.doc_id, coalesce(h.score, 0) {bias} AS score FROM {name}_a a JOIN dl USING (domain) LEFT JOIN (SELECT domain, query_id, doc_id, score FROM {name}_h) h ON h.domain = a.domain AND h.query_id = a.query_id AND h.doc_id = dl.doc_id"
    out.append(f"{name} AS (SELECT domain, query_id, row_number() OVER (PARTITION BY domain, query_id ORDER BY {order}) AS rank, doc_id, score FROM ({every}) QUALIFY rank <= {depth})")
    return out


def ranked(name: str, source: str, order: str, depth: int | None = None) -> str:
    places = f"SELECT domain, query_id, row_number() OVER (PARTITION BY domain, query_id ORDER BY {order}) AS place, doc_id, score FROM ({source})"
    return f"{name} AS (SELECT domain, query_id, place AS rank, doc_id, score FROM ({places})" + (f" WHERE place <= {depth})" if depth else ")")


def query(tables: list[str], select: str) -> str:
    return "WITH " + ",\n".join(dict.fromkeys(tables)) + "\n" + select


def shown(name: str = "run") -> str:
    return f"SELECT domain, query_id, rank, doc_id, round(score, 6) AS score FROM {name}"


def _ideal(n: str) -> str:
    return f"list_sum(list_transform(range(1, ({n}) + 1), lambda i: 1 / log2(i + 1)))"


def metrics(run_name: str = "run", name: str = "scores", k: int = 10) -> list[str]:
    """Tables that end in the metrics of each query."""
    return [
        f"{name}_j AS (SELECT r.domain, r.query_id, r.rank, (g.doc_id IS NOT NULL)::INT AS rel, sum((g.doc_id IS NOT NULL)::INT) OVER (PARTITION BY r.domain, r.query_id ORDER BY r.rank) AS seen FROM {run_name} r LEFT JOIN gold g USING (domain, query_id, doc_id))",
        "goldn AS (SELECT domain, query_id, count(*) AS n_gold FROM gold GROUP BY ALL)",
        f"""{name}_m AS (SELECT domain, query_id, count(*) AS n_returned, sum(rel)::BIGINT AS found, count(*) FILTER (rank <= {k} AND rel = 1) AS hits, count(*) FILTER (rank <= 100 AND rel = 1) AS deep,
            coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k} AND rel = 1), 0) AS dcg, coalesce(sum(seen / rank) FILTER (rel = 1), 0) AS sp, min(rank) FILTER (rel = 1) AS best_rank FROM {name}_j GROUP BY ALL)""",
        f"""{name} AS (SELECT domain, query_id, n_gold, n_returned, found, best_rank, dcg / {_ideal(f'least(n_gold, {k})')} AS ndcg, hits / least({k}, n_returned) AS precision, deep / n_gold AS recall, hits / n_gold AS recall_at_cut,
            CASE WHEN hits > 0 THEN 2 * (hits / least({k}, n_returned)) * (hits / n_gold) / (hits / least({k}, n_returned) + hits / n_gold) ELSE 0 END AS f1, sp / n_gold AS map,
            coalesce({_ideal(f'least(found, {k})')}, 0) / {_ideal(f'least(n_gold, {k})')} AS ceiling FROM {name}_m JOIN goldn USING (domain, query_id))""",
    ]


def domains(scores: str = "scores", run_name: str = "run", name: str = "doms") -> list[str]:
    return [
        f"{name}_g AS (SELECT domain, count(DISTINCT query_id) AS n_gold_queries FROM gold GROUP BY ALL)",
        f"{name} AS (SELECT domain, coalesce(n_topics, 0) AS n_topics, coalesce(n_gold_queries, 0) AS n_gold_queries, {', '.join(f'coalesce({m}, 0) AS {m}' for m in METRICS)} FROM (SELECT DISTINCT domain FROM {run_name}) LEFT JOIN (SELECT domain, count(*) AS n_topics, {', '.join(f'avg({m}) AS {m}' for m in METRICS)} FROM {scores} GROUP BY ALL) USING (domain) LEFT JOIN {name}_g USING (domain))",
    ]


KEY = r"sha1(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))"
GROUPS = [f"keyed AS (SELECT domain, doc_id, {KEY} AS key FROM corpus)", "groups AS (SELECT domain, doc_id, min(doc_id) OVER (PARTITION BY domain, key) AS canonical_id FROM keyed QUALIFY count(*) OVER (PARTITION BY domain, key) > 1)"]


def dedup(source: str, name: str, expand: int, limit: int | None = None) -> list[str]:
    marked = f"SELECT r.*, coalesce(canonical_id, doc_id) AS c FROM {source} r LEFT JOIN groups USING (domain, doc_id)"
    heads = f"SELECT *, min(rank) OVER (PARTITION BY domain, query_id, c) AS head, row_number() OVER (PARTITION BY domain, query_id, c ORDER BY rank) AS twin FROM ({marked})"
    return [*GROUPS, ranked(name, f"SELECT * FROM ({heads}) WHERE twin <= {expand}", "head, twin", limit)]


def rrf(sources: list[str], name: str, k: int, depth: int | None = None) -> list[str]:
    votes = " UNION ALL ".join(f"SELECT domain, query_id, doc_id, 1 / ({k} + rank) AS v FROM {s}" for s in sources)
    return [ranked(name, f"SELECT domain, query_id, doc_id, sum(v) AS score FROM ({votes}) GROUP BY ALL", "round(score, 12) DESC, doc_id", depth)]


def number(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


SPLIT = [
    f"numbered AS (SELECT domain, query_id, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY {number('domain', 'query_id')}, query_id) AS k FROM queries)",
    "split AS (SELECT domain, query_id, CASE WHEN k <= CASE WHEN n > 1 THEN least(greatest(1, round_even(n * 0.8, 0)), n - 1) ELSE n END THEN 'fit' ELSE 'check' END AS part FROM numbered)",
]
UNIT = "list_transform({v}, lambda x: x::DOUBLE / sqrt(list_sum(list_transform({v}, lambda y: y::DOUBLE * y::DOUBLE))))"
MARKUP = _list(MARKUP_WORDS)
SHORT = _list(ENGLISH_SHORT)
