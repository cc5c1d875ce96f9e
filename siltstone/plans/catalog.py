"""name -> query and SQL twin of the reference's operators. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import answer, chunk, evaluate, logs, retrieval, rules, tables, tools
from siltstone.plans import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL twin where there is one."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _asked(spark, d):
    """Questions and corpus."""
    return X.table(spark, d, "benchmark").select("item_id", "text"), retrieval.corpus(X.table(spark, d, "documents"))


# --- retrieval --------------------------------------------------------------------------------------

_TOKENS = "list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
_F1 = "CASE WHEN len(list_intersect(a, b)) > 0 THEN 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) ELSE 0.0 END"
_BASE = f"""q AS (SELECT item_id, text, list_distinct({_TOKENS}) AS words FROM benchmark),
d AS (SELECT doc_id, text, {_TOKENS} AS tokens FROM documents WHERE text <> ''),
asked AS (SELECT item_id, unnest(words) AS term FROM q),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25_all AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 8) AS score FROM tf JOIN df USING (term) JOIN asked USING (term), stats GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm25_all),
words AS (SELECT 'd' AS side, doc_id AS id, unnest(tokens) AS term FROM d UNION ALL SELECT 'q', item_id, unnest({_TOKENS.replace("coalesce(text", "coalesce(q.text")}) FROM q),
hashed AS (SELECT side, id, term, count(*) AS tf, md5(term) AS m FROM words GROUP BY ALL),
dims AS (SELECT side, id, list_sum([(strpos('0123456789abcdef', m[i + 1]) - 1) * (16 ** (3 - i)) for i in range(0, 4)])::BIGINT % 384 AS dim, sum(CASE WHEN strpos('0123456789abcdef', m[5]) <= 8 THEN tf ELSE -tf END)::DOUBLE AS w FROM hashed GROUP BY ALL),
unit AS (SELECT side, id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS w FROM dims WHERE w <> 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT x.id AS item_id, y.id AS doc_id, round(sum(x.w * y.w), 8) AS score FROM unit x JOIN unit y ON x.side = 'q' AND y.side = 'd' AND x.dim = y.dim GROUP BY ALL)),
fused AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM (SELECT * FROM bm25 WHERE rank <= 20 UNION ALL SELECT * FROM dense WHERE rank <= 20) GROUP BY ALL)),
reranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT item_id, doc_id, round({_F1}, 8) AS score FROM (SELECT f.item_id, f.doc_id, q.words AS a, list_distinct(d.tokens) AS b FROM fused f JOIN q USING (item_id) JOIN d USING (doc_id) WHERE f.rank <= 20)))"""


def _ranked(name: str, k: int) -> str:
    return f"WITH {_BASE} SELECT item_id, doc_id, rank, score FROM {name} WHERE rank <= {k}"


@query(_ranked("bm25", 5))
def bm25_top5(spark, d):
    return retrieval.bm25(*_asked(spark, d), 5)


@query(_ranked("bm25", 5))
def bm25_index_top5(spark, d):
    """The same from a stored index that took in every document with other words first, and two of each, then the right ones, while the second ones went."""
    from siltstone.operators.segments import Index
    from siltstone.sources.shared import scratch

    questions, docs = _asked(spark, d)
    index = Index(spark, scratch(spark, "index"))
    second = docs.select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    index.apply("first", docs.select("doc_id", F.concat(F.lit("other "), "text").alias("text")).unionByName(second))
    index.apply("second", docs.select("doc_id", "text"), second.select("doc_id"))
    return index.search(questions, 5)


@query(_ranked("dense", 5))
def dense_top5(spark, d):
    return retrieval.dense(*_asked(spark, d), 5)


@query(_ranked("fused", 8))
def hybrid_rrf_top8(spark, d):
    return retrieval.hybrid(*_asked(spark, d))


@query(_ranked("reranked", 8))
def hybrid_rerank_top8(spark, d):
    return retrieval.hybrid_reranked(*_asked(spark, d))


_ALL = f"{X.QUESTIONS_SQL}, {_BASE.replace('FROM benchmark)', 'FROM questions)')}"


def _all_asked(spark, d):
    """Questions, among them some that find nothing, and corpus."""
    return X.questions(spark, d), retrieval.corpus(X.table(spark, d, "documents"))


@query(f"WITH {_ALL} SELECT item_id, doc_id, rank, score FROM bm25 WHERE rank <= 5 UNION ALL SELECT item_id, doc_id, rank, score FROM dense WHERE rank <= 5 AND item_id NOT IN (SELECT item_id FROM bm25)")
def direct_fallback_top5(spark, d):
    """All questions are asked; those that find nothing are asked again by vectors."""
    q, docs = _all_asked(spark, d)
    return retrieval.with_fallback(retrieval.bm25(q, docs, 5), q, docs)


_SIDES = f"""sides AS (SELECT item_id * 2 + n AS item_id, array_to_string(list_filter([array_to_string(string_split(text, ' ')[1 + 3 * n:3 + 3 * n], ' '), array_to_string(string_split(text, ' ')[7:8], ' ')], lambda x: true), ' ') AS text FROM benchmark, (VALUES (0), (1)) AS v(n))"""


@query(f"WITH {_SIDES}, {_BASE.replace('FROM benchmark)', 'FROM sides)')} SELECT item_id // 2 AS item_id, (item_id % 2)::INT AS side, rank, doc_id, score FROM bm25 WHERE rank <= 5")
def compare_two_sided(spark, d):
    """Two independent retrievals for each comparison, in one pass."""
    return retrieval.compared(X.comparisons(spark, d), retrieval.corpus(X.table(spark, d, "documents")))


_HIT = "round(f.score, 4) AS score, o.source AS title, CASE WHEN o.doc_id % 3 = 0 THEN '' ELSE 'Điều ' || o.doc_id END AS header, o.lang AS url"


def _tools(spark, d):
    """Questions and chunks with titles, headers and addresses."""
    return X.table(spark, d, "benchmark").select("item_id", "text"), X.sourced(X.table(spark, d, "documents").where("text <> ''"))


@query(f"WITH {_BASE} SELECT f.item_id, f.rank, o.text[1:500] AS text, {_HIT} FROM fused f JOIN documents o USING (doc_id) WHERE f.rank <= 5")
def tool_search_top5(spark, d):
    return tools.search(*_tools(spark, d))


@query(f"WITH {_BASE} SELECT * FROM (SELECT f.item_id, f.rank, {_HIT}, o.text[1:200] AS excerpt FROM fused f JOIN documents o USING (doc_id) WHERE f.rank <= 8) WHERE header <> ''")
def article_extract_top8(spark, d):
    return tools.extract(*_tools(spark, d))


@query(f"WITH {_BASE}, s AS (SELECT f.item_id, string_agg(o.text[1:500], chr(10) || chr(10) ORDER BY f.rank) AS answer FROM fused f JOIN documents o USING (doc_id) WHERE f.rank <= 8 GROUP BY f.item_id) SELECT item_id, coalesce(answer, 'Không tìm thấy văn bản: ' || text) AS answer FROM q LEFT JOIN s USING (item_id)")
def tool_summarize(spark, d):
    """The default retriever gives eight results, fewer than the ten that a summary takes."""
    return tools.summarize(*_tools(spark, d))


@query(f"WITH {_BASE}, s AS (SELECT f.item_id, list({{'rank': f.rank, 'title': o.source}} ORDER BY f.rank) AS x FROM fused f JOIN documents o USING (doc_id) WHERE f.rank <= 8 GROUP BY f.item_id) SELECT item_id, list_transform(x[1:5], lambda y: y.title) AS shown, list_transform(x[1:3], lambda y: y.title) AS titles FROM s")
def shown_sources(spark, d):
    """The first five sources of an answer, cited or not, and the first three titles."""
    found = retrieval.hybrid(*_asked(spark, d))
    names = X.table(spark, d, "documents").select("doc_id", F.col("source").alias("name"))
    every = logs.source_titles(found, names, 8)
    return every.select("item_id", logs.shown_sources(F.col("titles")).alias("shown")).join(logs.source_titles(found, names), "item_id")


@query(f"WITH {_BASE} SELECT f.item_id, f.rank, o.source, o.lang, o.n_chars, round(f.score, 4) AS score FROM fused f JOIN documents o USING (doc_id) WHERE f.rank <= 8")
def source_projection(spark, d):
    q, docs = _asked(spark, d)
    return retrieval.hits(retrieval.hybrid(q, docs), docs).select("item_id", "rank", "doc_id", "score").join(X.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id").drop("doc_id")


@query(f"WITH {_BASE} SELECT f.item_id, f.doc_id, o.source, o.lang, o.n_chars FROM fused f JOIN documents o USING (doc_id) WHERE f.rank = 1")
def metadata_top1(spark, d):
    q, docs = _asked(spark, d)
    return retrieval.hybrid(q, docs, 1).select("item_id", "doc_id").join(X.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")


@query()
def knn_index_top5(spark, d):
    """The same from the index of cells and codes, approximately."""
    from siltstone.operators import ann
    from siltstone.sources.shared import scratch

    v = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = ann.build(v, scratch(spark, "knn-index"))
    return index.search(v.where("id % 100 = 0").withColumnRenamed("id", "query")).select(F.col("query").alias("query_id"), F.col("id").alias("vec_id"), "score", "rank")


@query("""SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""")
def knn_embeddings_top5(spark, d):
    """The stated queries are the vectors whose id is divisible by 100."""
    v = X.table(spark, d, "embeddings").select("vec_id", "embedding")
    return retrieval.knn(v.where("vec_id % 100 = 0"), v)


# --- text ------------------------------------------------------------------------------------------

_CLEAN = "regexp_replace(nfc_normalize(text), '[–—]', '-', 'g')"
_CLEAN = f"replace(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[“”]', '\"', 'g'), '[‘’]', '''', 'g'), '[​﻿]', '', 'g'), chr(160), ' ')"
for _p, _by in (("\\s{3,}", "'  '"), ("\\n{3,}", "chr(10) || chr(10)"), ("\\.{4,}", "''"), ("[-─]{10,}", "''"), ("Trang\\s+\\d+\\s*/\\s*\\d+", "''"), ("(?m)^\\s*\\d+\\s*$", "''")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', {_by}, 'g')"
_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_CLEAN = _STRIP.format(_CLEAN)
for _h, _n in (("Điều", "\\d+"), ("Chương", "[IVXLCDM]+"), ("Mục", "\\d+")):
    # Without look-behind: a header at the beginning or after another character than a line break.
    _CLEAN = f"regexp_replace({_CLEAN}, '(^|[^\\n])({_h}\\s+{_n})', '\\1' || chr(10) || chr(10) || '\\2', 'g')"
    _CLEAN = f"regexp_replace({_CLEAN}, '\\n{{3,}}({_h}\\s+{_n})', chr(10) || chr(10) || '\\1', 'g')"
_CLEAN = f"CASE WHEN coalesce(text, '') ~ '.*\\S.*' OR regexp_matches(coalesce(text, ''), '\\S') THEN {_STRIP.format(f'regexp_replace({_CLEAN}, {chr(39)}[ \\t]{{2,}}{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')} ELSE '' END"


@query(f"WITH {X.DIRTY_DOCS} SELECT doc_id, {_CLEAN} AS text FROM dirty_docs")
def clean_text(spark, d):
    return X.dirty_docs(spark, d).select("doc_id", T.cleaned(F.col("text")).alias("text"))


_HEAD = "Điều\\s+\\d+[a-z]?[.:]"
_PIECES = f"""pieces AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '({_HEAD})', chr(1) || '\\1', 'g'), chr(1)), lambda p: regexp_matches(p, '^{_HEAD}\\s')) AS p FROM article_docs),
found AS (SELECT doc_id, {_STRIP.format('unnest(p)')} AS article, unnest(range(len(p))) AS n FROM pieces),
kept AS (SELECT * FROM found WHERE length(article) >= 50)"""
_PACK = """list_reduce(list_transform({parts}, lambda part: {{'done': []::VARCHAR[], 'buffer': part}}), lambda a, b: CASE WHEN length(a.buffer) + length(b.buffer) <= {most}
    THEN {{'done': a.done, 'buffer': a.buffer || {joint} || b.buffer}} ELSE {{'done': list_append(a.done, a.buffer), 'buffer': b.buffer}} END)"""


@query(f"""WITH {X.ARTICLE_DOCS}, {_PIECES}
SELECT doc_id, n * 10000 AS chunk_index, 'article' AS strategy, article AS text, string_split(article, chr(10))[1][1:120] AS header, len(regexp_extract_all(article, '\\n\\d+\\.\\s')) AS clause_count, length(article) AS char_count FROM kept WHERE length(article) <= 4000""")
def chunk_articles(spark, d):
    return chunk.chunks(X.article_docs(spark, d)).where("strategy = 'article'")


@query(f"""WITH long AS (SELECT doc_id, source, 'Điều 1. T' || list_aggregate(list_transform(string_split(text, '. '), lambda s, j: chr(10) || j || '. ' || s), 'string_agg', '') AS text FROM documents),
packed AS (SELECT doc_id, text, {_PACK.format(parts="string_split(regexp_replace(text, '(\\n\\d+\\.\\s)', chr(1) || '\\1', 'g'), chr(1))", most=4000, joint="''")} AS s FROM (SELECT doc_id, {_STRIP.format('text')} AS text FROM long) WHERE length(text) > 4000),
rows AS (SELECT doc_id, text, unnest(list_append(s.done, s.buffer)) AS b, unnest(range(len(s.done) + 1)) AS m FROM packed)
SELECT doc_id, m AS chunk_index, 'clauses' AS strategy, ({_STRIP.format('b')})[1:4000] AS text, string_split(text, chr(10))[1][1:120] AS header, 0 AS clause_count, length(b) AS char_count FROM rows""")
def chunk_split_large(spark, d):
    docs = X.table(spark, d, "documents")
    text = F.expr("concat('Điều 1. T', array_join(transform(split(text, '[.] '), (s, j) -> concat('\n', j + 1, '. ', s)), ''))")
    return chunk.chunks(docs.select("doc_id", text.alias("text"))).where("strategy = 'clauses'")


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\n+'), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS ps FROM documents),
packed AS (SELECT doc_id, {_PACK.format(parts="ps", most=800, joint="chr(10) || chr(10)")} AS s FROM p WHERE len(ps) > 0),
rows AS (SELECT doc_id, unnest(list_append(s.done, s.buffer)) AS text, unnest(range(len(s.done) + 1)) AS n FROM packed)
SELECT doc_id, n * 10000 AS chunk_index, 'window' AS strategy, text, text[1:80] AS header, NULL::BIGINT AS clause_count, length(text) AS char_count FROM rows""")
def chunk_fallback_pack(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunk.chunks(docs)


@query(f"""WITH {X.MIXED_DOCS}, parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?i)(Điều\\s+\\d+[.:])', chr(1) || '\\1', 'g'), chr(1)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS p FROM mixed_docs),
rows AS (SELECT doc_id, unnest(p) AS text, unnest(range(len(p))) AS chunk_index FROM parts) SELECT doc_id, chunk_index, text, string_split(text, chr(10))[1][1:120] AS header FROM rows WHERE length(text) >= 30""")
def chunk_second(spark, d):
    return chunk.second_chunks(X.mixed_docs(spark, d))


@query(f"WITH {X.ARTICLE_DOCS}, {_PIECES} SELECT doc_id, count(*) AS n_articles, sum(len(regexp_extract_all(article, '\\n\\d+\\.\\s')))::BIGINT AS n_clauses FROM kept GROUP BY doc_id")
def clause_counts(spark, d):
    rows = X.article_docs(spark, d).select("doc_id", F.explode(T.articles(F.col("text"))).alias("a")).select("doc_id", T.stripped(F.col("a")).alias("a")).where(F.length("a") >= 50)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_articles"), F.sum(T.clause_count(F.col("a"))).alias("n_clauses"))


_NUMBER = "coalesce(" + ", ".join("nullif(regexp_replace(regexp_extract(title, '" + p.replace("\\w", "\\pL\\pN_").replace("[\\pL\\pN_\\-Đđ]", "[\\pL\\pN_\\-]") + "', 1), '^\\.+|\\.+$', '', 'g'), '')" for p in T.DOC_NUMBERS) + ", '')"


@query(f"WITH {X.TITLED_DOCS} SELECT doc_id, {_NUMBER} AS so_hieu, regexp_extract(title, '\\d+/\\d{{4}}/[A-Z0-9-]+', 0) AS simple FROM titled_docs")
def doc_number_extract(spark, d):
    t = F.col("title")
    return X.titled_docs(spark, d).select("doc_id", T.document_number(t).alias("so_hieu"), T.simple_number(t).alias("simple"))


_DATE = "ngày\\s+(\\d{1,2})\\s+tháng\\s+(\\d{1,2})\\s+năm\\s+(\\d{4})"
_ISO = "regexp_extract({0}, '{1}', 3) || '-' || lpad(regexp_extract({0}, '{1}', 2), 2, '0') || '-' || lpad(regexp_extract({0}, '{1}', 1), 2, '0')"
_SIGNED = f"CASE WHEN regexp_matches(text, 'Hà\\s+Nội[,\\s]+{_DATE}') THEN {_ISO.format('text', 'Hà\\s+Nội[,\\s]+' + _DATE)} WHEN regexp_matches(text, '{_DATE}') THEN {_ISO.format(f'regexp_extract_all(text, {chr(39)}{_DATE}{chr(39)})[-1]', _DATE)} ELSE '' END"


@query(f"WITH {X.TITLED_DOCS} SELECT doc_id, {_SIGNED} AS signed FROM titled_docs")
def signing_date_extract(spark, d):
    return X.titled_docs(spark, d).select("doc_id", T.signing_date(F.col("text")).alias("signed"))


_SLUG = "string_split(string_split(regexp_replace(url, '/+$', ''), '/')[-1], '.')[1]"
_TYPE = "CASE " + " ".join(f"WHEN starts_with({_SLUG}, '{p}') THEN '{k}'" for p, k in T.DOC_TYPES) + " ELSE 'other' END"


@query(f"WITH {X.TITLED_DOCS} SELECT doc_id, {_TYPE} AS doc_type FROM titled_docs")
def doc_type_from_url(spark, d):
    return X.titled_docs(spark, d).select("doc_id", T.doc_type(F.col("url")).alias("doc_type"))


@query(f"""WITH {X.TITLED_DOCS} SELECT doc_id, {_STRIP.format("regexp_replace(title, '[^\\pL\\pN_\\s\\-]', '_', 'g')[1:80]")} AS words, {_STRIP.format("regexp_replace(title, '[^\\pL\\pN \\-_]', '_', 'g')[1:80]")} AS plain,
{_STRIP.format("regexp_replace(title, '[^a-zA-Z0-9_-]', '_', 'g')[1:60]")} AS ascii FROM titled_docs""")
def safe_filenames(spark, d):
    t = F.col("title")
    return X.titled_docs(spark, d).select("doc_id", *(T.safe_filename(t, k).alias(k) for k in ("words", "plain", "ascii")))


@query("""WITH l AS (SELECT page_id, 'https://' || split_part(split_part(url, '://', 2), '/', 1) AS base, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, 'href="([^"]+)"', 1)))) AS pos FROM pages),
a AS (SELECT page_id, pos, CASE WHEN starts_with(href, '/') THEN base || href ELSE href END AS link FROM l WHERE starts_with(href, '/') OR regexp_matches(href, '^https?://([^/]*\\.)?example\\.(com|net)(/|$)'))
SELECT page_id, link, min(pos) AS pos FROM a GROUP BY ALL""")
def html_links_allowlisted(spark, d):
    from siltstone.sources.html import links

    return links(X.table(spark, d, "pages"), ("example.com", "example.net"))


@query(f"""WITH {X.ANCHORS_SQL}, l AS (SELECT page_id % 4 AS type_no, page_id // 4 + 1 AS page, page_id FROM pages), n AS (SELECT type_no, page, l.page_id, pos, url FROM l JOIN anchors a ON a.page_id = l.page_id AND l.page_id % 11 <> 0),
e AS (SELECT type_no, min(page) AS stop FROM (SELECT l.type_no, l.page, count(n.url) AS links FROM l LEFT JOIN n ON n.page_id = l.page_id WHERE l.page <= 5 GROUP BY ALL) WHERE links = 0 GROUP BY type_no)
SELECT row_number() OVER (ORDER BY n.type_no, page, pos) AS place, url FROM n LEFT JOIN e USING (type_no) WHERE page <= 5 AND page < coalesce(stop, 6) ORDER BY n.type_no, page, pos LIMIT 100""")
def crawl_plan(spark, d):
    """The documents that a crawl over captured pages keeps; it stops at 100."""
    from siltstone.sources import crawl, html

    return crawl.crawled(X.listings(spark, d), html.anchors(X.table(spark, d, "pages")))


@query(f"""WITH {X.ANCHORS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY pos) AS r FROM (SELECT page_id, pos, 'https://h.example' || regexp_replace(url, '^https?://[^/]*', '') AS url, CASE WHEN pos % 4 = 0 THEN '' ELSE text END AS text FROM anchors))
SELECT page_id, url, coalesce(nullif(text[1:200], ''), string_split(url, '/')[-1]) AS title, {_TYPE} AS doc_type, pos FROM h WHERE r = 1""")
def issue_documents(spark, d):
    """Documents of an issue's page, titled by their links or addresses."""
    from siltstone.sources import crawl, html

    rows = html.anchors(X.table(spark, d, "pages")).withColumn("url", F.concat(F.lit("https://h.example"), F.regexp_replace("url", "^https?://[^/]*", ""))).withColumn("text", F.when(F.col("pos") % 4 == 0, "").otherwise(F.col("text")))
    return crawl.issue_documents(rows, "h.example")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY keyword_no, pos) AS place FROM (SELECT event_type AS category, user_id % 5 AS keyword_no, event_id AS pos, 'u' || user_id % 40 AS url FROM events)),
f AS (SELECT *, row_number() OVER (PARTITION BY category, url ORDER BY place) AS r FROM r WHERE place <= 50) SELECT category, url, place FROM f WHERE r = 1""")
def discovered_urls(spark, d):
    """The first 50 results of each category, then each address once."""
    from siltstone.sources import crawl

    rows = X.table(spark, d, "events").select(F.col("event_type").alias("category"), (F.col("user_id") % 5).alias("keyword_no"), F.col("event_id").alias("pos"), F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("url"))
    return crawl.discovered(rows, 50).select("category", "url", "place")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'skipped' WHEN text IS NULL THEN 'failed' WHEN length(text) < 100 THEN 'short' ELSE 'saved' END AS status
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) UNION ALL SELECT 'failed' FROM benchmark) GROUP BY status""")
def crawl_counters(spark, d):
    """Documents as what a crawl brought, those with labels as known before, and a link for each benchmark item that brought nothing."""
    from siltstone.sources import crawl

    known = X.table(spark, d, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    rows = X.table(spark, d, "documents").select("doc_id", F.col("text").alias("content")).join(known, "doc_id", "left").select("content", F.coalesce("known", F.lit(False)).alias("known"))
    nothing = X.table(spark, d, "benchmark").select(F.lit(None).cast("string").alias("content"), F.lit(False).alias("known"))
    return crawl.counters(rows.unionByName(nothing))


_TEXT = "regexp_replace(html, '(?is)<(script|style|nav|header|footer)\\b.*?</(script|style|nav|header|footer)>', '', 'g')"
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', chr(10), 'g')"
_TEXT = _STRIP.format(f"regexp_replace(regexp_replace({_TEXT}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query(f"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, {_TEXT} AS text FROM pages WHERE length({_TEXT}) >= 200")
def html_main_text(spark, d):
    from siltstone.sources.html import main_text

    return main_text(X.table(spark, d, "pages"))


@query(f"""WITH m AS (SELECT doc_id, '<!-- a' || chr(10) || 'b -->' || replace(text, chr(10), repeat(chr(10), 4)) AS text FROM documents)
SELECT doc_id, {_STRIP.format("regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), chr(10)), lambda x: CASE WHEN length(x) > 2000 THEN x[1:2000] || '…[cắt bớt]' ELSE x END), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM m""")
def markdown_clean(spark, d):
    text = F.concat(F.lit("<!-- a\nb -->"), F.replace("text", F.lit("\n"), F.lit("\n\n\n\n")))
    return X.table(spark, d, "documents").select("doc_id", T.markdown_cleaned(text).alias("text"))


# --- stored tables ------------------------------------------------------------------------------------


@query(f"WITH {X.ARTICLE_DOCS}, {_PIECES} SELECT doc_id, n * 10000 AS chunk_index, sha256(doc_id || chr(1) || n * 10000 || chr(1) || article) AS chunk_id FROM kept WHERE length(article) <= 4000")
def chunk_ids(spark, d):
    return chunk.with_ids(chunk.chunks(X.article_docs(spark, d)).where("strategy = 'article'")).select("doc_id", "chunk_index", "chunk_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing_anti(spark, d):
    """Documents that the labels don't know yet."""
    return tables.new_rows(X.table(spark, d, "documents").select("doc_id", "source"), X.table(spark, d, "labels"), "doc_id")


@query("""WITH u AS (SELECT user_id AS doc_id, event_type AS source, event_id AS version FROM events), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY version DESC) AS r FROM u) WHERE r = 1)
SELECT doc_id, source, -1 AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM u) UNION ALL SELECT doc_id, source, version FROM l""")
def upsert_last_wins(spark, d):
    base = X.table(spark, d, "documents").select("doc_id", "source", F.lit(-1).cast("long").alias("version"))
    return tables.upserted(base, X.table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("source"), F.col("event_id").alias("version")), "doc_id", "version")


@query(f"""WITH {X.TITLED_DOCS}, e AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE '' END AS old, {_NUMBER} AS num, {_SIGNED} AS day FROM titled_docs)
SELECT doc_id, CASE WHEN old = '' THEN num ELSE old END AS so_hieu, day AS ngay_ban_hanh, (old = '' AND num <> '') OR day <> '' AS changed FROM e""")
def metadata_backfill(spark, d):
    rows = X.titled_docs(spark, d).withColumns({"so_hieu": F.when(F.col("doc_id") % 4 == 0, "kept").otherwise(""), "ngay_ban_hanh": F.lit("")})
    return tables.backfilled(rows, {"so_hieu": T.document_number(F.col("title")), "ngay_ban_hanh": T.signing_date(F.col("text"))}).select("doc_id", "so_hieu", "ngay_ban_hanh", "changed")


@query(f"WITH {_BASE}, p AS (SELECT x.doc_id = y.doc_id AS same FROM bm25 x JOIN dense y USING (item_id) WHERE x.rank = 1 AND y.rank = 1) SELECT count(*) AS n_rows, count(*) FILTER (same) AS n_same, bool_and(same) AS equal FROM p")
def migration_parity(spark, d):
    """Whether two stores give the same first hit."""
    q, docs = _asked(spark, d)
    return tables.parity(retrieval.bm25(q, docs, 1), retrieval.dense(q, docs, 1), "item_id", "doc_id")


@query(f"WITH {X.ARTICLE_DOCS}, {_PIECES} SELECT source, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM kept JOIN documents USING (doc_id) WHERE length(article) <= 4000 GROUP BY source")
def registry_counts(spark, d):
    rows = chunk.chunks(X.article_docs(spark, d)).where("strategy = 'article'").select("doc_id")
    return tables.registry(rows.join(X.table(spark, d, "documents").select("doc_id", "source"), "doc_id"))


_PUBLIC = "['a_b=_kept', 'source=' || coalesce(source, '~')]"


def _pairs(metadata):
    """A map as sorted texts key=value."""
    return F.array_sort(F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("~")))))


@query(f"SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN n_chars / 1000 ELSE 0.0 END::DOUBLE AS score, list_sort(['doc_id=' || doc_id, 'document_id=' || doc_id, 'ref_doc_id=r'] || {_PUBLIC}) AS metadata FROM documents")
def node_chunks(spark, d):
    """Nodes as chunks: a missing score is 0, keys that begin with an underscore go."""
    return X.payloads(spark, d).select("doc_id", "text", F.coalesce("score", F.lit(0.0)).alias("score"), _pairs(T.public_metadata(F.col("payload"))).alias("metadata"))


@query(f"SELECT doc_id, text, {_PUBLIC} AS metadata FROM documents WHERE doc_id % 5 NOT IN (0, 1) AND text <> ''")
def payload_flatten(spark, d):
    """Stored points with a text, without the store's own keys."""
    rows = X.payloads(spark, d).select("doc_id", T.payload_text(F.col("payload")).alias("text"), _pairs(T.public_metadata(F.col("payload"), T.INTERNAL)).alias("metadata"))
    return rows.where("text <> ''")


@query(f"WITH {_BASE} SELECT item_id, doc_id, round(score, 6) AS similarity, round(1 / (2 - score), 6) AS inverse_distance, round(score, 6) AS one_less_distance FROM dense WHERE rank <= 5")
def score_scales_top5(spark, d):
    """Dense results on the scales of the two stores and of the ablation."""
    return retrieval.dense(*_asked(spark, d), 5).select("item_id", "doc_id", *(F.round(v, 6).alias(n) for n, v in T.score_scales(F.col("score")).items()))


# --- guards and requests ----------------------------------------------------------------------------------

_hit = lambda p, c="query": f"regexp_matches({c}, '(?i){p}')"
_CATEGORY = "CASE " + " ".join(f"WHEN {_hit(p)} THEN '{c}'" for p, c in T.INJECTION) + " END"
_HEURISTIC = f"(CASE WHEN regexp_matches(query, '[\\x{{400}}-\\x{{4FF}}\\x{{370}}-\\x{{3FF}}]') THEN 1.0 ELSE 0.0 END + CASE WHEN {_hit(T.VERBS)} AND {_hit(T.SELF)} THEN 1.0 ELSE 0.0 END + CASE WHEN length(query) > 600 THEN 0.5 ELSE 0.0 END)::DOUBLE"


@query(f"""WITH {X.PROMPTS_SQL}, g AS (SELECT conv_id, turn, {_CATEGORY} AS c, {_HEURISTIC} AS s FROM prompts)
SELECT conv_id, turn, c IS NOT NULL OR s >= 1.5 AS blocked, coalesce(c, CASE WHEN s >= 1.5 THEN 'heuristic' END, '') AS category, CASE WHEN c IS NOT NULL THEN 1.0 ELSE s END::DOUBLE AS score FROM g""")
def guard_injection(spark, d):
    return X.prompts(spark, d).select("conv_id", "turn", T.injection(F.col("query")).alias("g")).select("conv_id", "turn", "g.*")


_Q = "CASE conv_id % 7 WHEN 0 THEN '  x ' WHEN 1 THEN repeat(text, 9) WHEN 2 THEN 'a <SCRIPT b' || text ELSE '  ' || text END"


@query(f"""WITH r AS (SELECT conv_id, turn, {_STRIP.format(_Q)} AS q, CASE WHEN turn = 3 THEN 'a b' ELSE 's-' || conv_id END AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN length(q) < 3 THEN 'too_short' WHEN length(q) > 1000 THEN 'too_long' WHEN contains(lower(q), '<script') OR contains(lower(q), 'javascript:') OR contains(lower(q), 'data:text') OR contains(lower(q), '\\x00') THEN 'forbidden'
WHEN NOT regexp_matches(s, '^[a-zA-Z0-9_-]{{1,64}}$') THEN 'bad_session' END AS reason FROM r""")
def validate_request(spark, d):
    rows = X.table(spark, d, "conversations").select("conv_id", "turn", F.expr(_Q).alias("q"), F.expr("if(turn = 3, 'a b', concat('s-', conv_id))").alias("s"))
    return rows.select("conv_id", "turn", T.rejection(F.col("q"), F.col("s")).alias("reason"))


@query("""SELECT doc_id, CASE WHEN contains(m, 'api_key') OR contains(m, 'password') OR contains(m, 'token') OR contains(m, 'secret') OR contains(m, 'bearer ') THEN '[REDACTED — contains sensitive data]' ELSE text END AS message FROM (SELECT doc_id, text, lower(text) AS m FROM documents)""")
def redact_logs(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.redacted(F.col("text")).alias("message"))


_MARKS = "list_transform(regexp_extract_all(regexp_replace(answer, '([\\pL\\pN_])\\[', '\\1 ', 'g'), '\\[(\\d{1,2})\\](?:[^\\pL\\pN_]|$)', 1), lambda x: x::INT)"


@query(f"WITH {X.ANSWERS_SQL} SELECT item_id, CASE WHEN answer <> '' THEN list_sort(list_distinct(list_filter({_MARKS}, lambda x: x < 1 OR x > 5))) ELSE [] END AS invalid FROM answers")
def citations_valid(spark, d):
    return X.answers(spark, d).select("item_id", T.invalid_citations(F.col("answer"), F.lit(5)).alias("invalid"))


@query(f"""WITH {X.ANSWERS_SQL}, {_BASE}, marks AS (SELECT DISTINCT item_id, unnest(list_transform(list_filter(list_transform(flatten(list_transform(regexp_extract_all(answer, '\\[([\\d,\\s]+)\\]', 1), lambda s: string_split(s, ','))), lambda p: trim(p)), lambda p: regexp_matches(p, '^\\d+$')), lambda p: p::INT)) AS rank FROM answers)
SELECT f.item_id, f.rank, f.doc_id FROM fused f JOIN marks USING (item_id, rank) WHERE f.rank <= 8""")
def citations_cited_sources(spark, d):
    return answer.cited(X.answers(spark, d), retrieval.hybrid(*_asked(spark, d))).select("item_id", "rank", "doc_id")


def _budget(cut: str, total: int, most: int) -> str:
    return f"WITH {_BASE}, s AS (SELECT f.item_id, f.rank, f.doc_id, sum(length({cut})) OVER (PARTITION BY f.item_id ORDER BY f.rank) AS chars FROM fused f JOIN d USING (doc_id) WHERE f.rank <= {most}) SELECT item_id, rank, doc_id, chars::BIGINT AS chars FROM s WHERE chars <= {total}"


@query(_budget("CASE WHEN length(d.text) > 3000 THEN d.text[1:3000] || '…' ELSE d.text END", 15000, 20))
def context_budget(spark, d):
    q, docs = _asked(spark, d)
    return answer.context(retrieval.hybrid(q, docs, 20), docs).select("item_id", "rank", "doc_id", "chars")


@query(_budget("d.text[1:250]", 2500, 12))
def judge_budget(spark, d):
    q, docs = _asked(spark, d)
    return answer.judge_excerpts(retrieval.hybrid(q, docs, 20), docs).select("item_id", "rank", "doc_id", "chars")


@query(f"WITH {_ALL}, g AS (SELECT item_id, count(*) AS n, max(score) AS best FROM reranked WHERE rank <= 8 GROUP BY item_id) SELECT q.item_id, coalesce(n, 0) AS n, best, CASE WHEN n IS NULL THEN 'irrelevant' WHEN best >= 0.1 THEN 'relevant' ELSE 'judge' END AS grade FROM q LEFT JOIN g USING (item_id)")
def grade_rows(spark, d):
    """Grades of all questions, also of those that find nothing."""
    q, docs = _all_asked(spark, d)
    return answer.grade(q, retrieval.hybrid_reranked(q, docs))


@query(f"""WITH {_BASE}, x AS (SELECT f.item_id, f.rank, {_STRIP.format("regexp_replace(d.text, '\\s+', ' ', 'g')")} AS t FROM fused f JOIN d USING (doc_id) WHERE f.rank <= 5)
SELECT item_id, string_agg('**[' || rank || '] Doc**' || chr(10) || CASE WHEN length(t) > 700 THEN regexp_replace(t[1:700], '\\s+$', '') || '...' ELSE t END, chr(10) || chr(10) ORDER BY rank) AS answer FROM x GROUP BY item_id""")
def extractive_answers(spark, d):
    q, docs = _asked(spark, d)
    return answer.extractive(retrieval.hybrid(q, docs), docs, F.lit("Doc"))


# --- intents, rules -----------------------------------------------------------------------------------------

QUESTIONS = ("So sánh QĐ-740 và QĐ-747 về học bổng", "Tóm tắt nội dung", "xuất PDF báo cáo", "điểm 5 có được không", "có được không", "sự khác nhau A vs B on cost", "học bổng là gì của trường", "là của và")


def _questions(spark, d):
    q = F.element_at(F.array(*(F.lit(x) for x in QUESTIONS)), ((F.col("conv_id") + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    return X.table(spark, d, "conversations").select("conv_id", "turn", F.concat(q, F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), "text")).otherwise("")).alias("query"))


_QUESTIONS = f"qs AS (SELECT conv_id, turn, ({X._list(QUESTIONS)})[(conv_id + turn) % {len(QUESTIONS)} + 1] || CASE WHEN turn % 2 = 0 THEN ' ' || text ELSE '' END AS query FROM conversations)"
_INTENT = "CASE " + " ".join("WHEN (" + " OR ".join(f"contains(lower(query), '{p}')" for p in ps) + ")" + (" AND regexp_matches(query, '\\d')" if n == "compliance_check" else "") + f" THEN '{n}'" for n, ps in T.INTENTS) + " ELSE 'simple_qa' END"


@query(f"WITH {_QUESTIONS}, i AS (SELECT conv_id, turn, {_INTENT} AS intent, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) AS n FROM qs) SELECT conv_id, turn, intent, intent <> 'simple_qa' OR n <= 6 AS fast FROM i")
def intent_keyword(spark, d):
    rows = _questions(spark, d).select("conv_id", "turn", T.intent(F.col("query")).alias("intent"), (T.word_count(F.col("query")) <= 6).alias("short"))
    return rows.select("conv_id", "turn", "intent", ((F.col("intent") != "simple_qa") | F.col("short")).alias("fast"))


_ROUTE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tools.ROUTES.items()) + " ELSE 'retrieve' END"


@query(f"WITH {_QUESTIONS}, i AS (SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'nonsense' WHEN turn = 2 THEN NULL ELSE {_INTENT} END AS intent FROM qs) SELECT conv_id, turn, {_ROUTE.format('intent')} AS node FROM i")
def intent_routes(spark, d):
    """The node of every question; labels that aren't known and missing ones go to retrieval."""
    said = F.when(F.col("turn") == 1, "nonsense").when(F.col("turn") != 2, T.intent(F.col("query")))
    return _questions(spark, d).select("conv_id", "turn", tools.route(said).alias("node"))


@query(f"""WITH {_QUESTIONS}, i AS (SELECT conv_id, turn, {_INTENT} AS own, len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) AS n, CASE turn % 3 WHEN 0 THEN ' Compare ' WHEN 1 THEN 'odd' END AS said FROM qs)
SELECT conv_id, turn, CASE WHEN own <> 'simple_qa' OR n <= 6 OR said IS NULL THEN own WHEN lower(trim(said)) IN ('simple_qa', 'compare', 'summarize', 'report', 'compliance_check') THEN lower(trim(said)) ELSE 'simple_qa' END AS intent FROM i""")
def intent_labelled(spark, d):
    """Keywords first, then a model's label, then simple_qa."""
    said = F.when(F.col("turn") % 3 == 0, " Compare ").when(F.col("turn") % 3 == 1, "odd")
    return _questions(spark, d).select("conv_id", "turn", tools.labelled(said, F.col("query")).alias("intent"))


_CUT = "regexp_replace(query, '(?i)\\s+(?:và|with|vs\\.?)\\s+', chr(1))"
_RIGHT = f"regexp_replace({_STRIP.format('string_split(c, chr(1))[2]')}, '(?i)\\s+(?:về|on|regarding)\\s+', chr(1))"


@query(f"""WITH {_QUESTIONS}, c AS (SELECT conv_id, turn, query, {_CUT} AS c FROM qs), e AS (SELECT *, contains(c, chr(1)) AS two, string_split({_RIGHT}, chr(1)) AS r FROM c)
SELECT conv_id, turn, CASE WHEN two THEN {_STRIP.format('string_split(c, chr(1))[1]')} ELSE query END AS a, CASE WHEN two THEN {_STRIP.format('r[1]')} ELSE query END AS b,
CASE WHEN two THEN coalesce(nullif({_STRIP.format('r[2]')}, ''), query) ELSE query END AS aspect FROM e""")
def compare_args(spark, d):
    return _questions(spark, d).select("conv_id", "turn", T.compare_arguments(F.col("query")).alias("c")).select("conv_id", "turn", "c.*")


@query(f"""WITH {_QUESTIONS}, w AS (SELECT conv_id, turn, query, array_to_string(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ({", ".join(f"'{s}'" for s in T.STOPWORDS)})), ' ') AS r FROM qs)
SELECT conv_id, turn, CASE WHEN r = '' OR r = 'học bổng gì trường' THEN query ELSE r END AS query FROM w""")
def reformulate_stopwords(spark, d):
    return _questions(spark, d).select("conv_id", "turn", T.reformulated(F.col("query"), F.array(F.lit("học bổng gì trường"))).alias("query"))


@query(f"WITH {X.SITUATIONS_SQL} SELECT sit_id, id FROM matched")
def compliance_keyword_match(spark, d):
    return rules.matched(X.situations(spark, d), X.criteria(spark)).select("sit_id", "id")


_VALUE = "replace(coalesce(" + ", ".join(f"nullif(regexp_extract(text, '(?i){p}', 1), '')" for p in (T.NEAR_LABEL, T.WITH_UNIT, T.NUMBER)) + "), ',', '.')::DOUBLE"


@query(f"WITH {X.SITUATIONS_SQL} SELECT sit_id, {_VALUE} AS value FROM situations")
def compliance_value_extract(spark, d):
    return X.situations(spark, d).select("sit_id", T.situation_value(F.col("text")).alias("value"))


_OK = "CASE op WHEN '>=' THEN value >= least WHEN '>' THEN value > least WHEN '<=' THEN value <= least END"


@query(f"""WITH {X.SITUATIONS_SQL}, v AS (SELECT sit_id, m.id, c.*, CASE WHEN m.id IS NOT NULL THEN {_VALUE.replace('text', 'm.text')} END AS value FROM matched m LEFT JOIN criteria c USING (id)), w AS (SELECT *, {_OK} AS ok FROM v)
SELECT sit_id, coalesce(id, '') AS criterion_id, CASE WHEN id IS NULL THEN 'no_match' WHEN value IS NULL THEN 'insufficient_info' WHEN ok THEN 'pass' ELSE 'fail' END AS verdict, value,
CASE WHEN id IS NULL THEN '' WHEN value IS NULL THEN replace('{T.VALUE_MISSING}', '%s', topic) ELSE replace(replace(CASE WHEN ok THEN yes ELSE no END, '{{dieu_khoan}}', dieu_khoan), '{{so_hieu}}', so_hieu) END AS explanation FROM w""")
def compliance_verdict(spark, d):
    return rules.verdicts(X.situations(spark, d), X.criteria(spark)).drop("so_hieu", "dieu_khoan")


@query(f"""WITH {X.NEAR_SQL}, words AS (SELECT 's' AS side, sit_id::VARCHAR AS id, unnest({_TOKENS}) AS term FROM matched WHERE id IS NULL UNION ALL SELECT 'c', id, unnest({_TOKENS.replace("coalesce(text", "coalesce(topic")}) FROM criteria),
{_BASE[_BASE.index("hashed AS"):_BASE.index("dense AS")]}
near AS (SELECT *, row_number() OVER (PARTITION BY sit_id ORDER BY score DESC, position) AS r FROM (SELECT x.id::BIGINT AS sit_id, y.id, round(sum(x.w * y.w), 8) AS score FROM unit x JOIN unit y ON x.side = 's' AND y.side = 'c' AND x.dim = y.dim GROUP BY ALL) JOIN (SELECT id, position FROM criteria) USING (id) WHERE score >= 0.45),
chosen AS (SELECT m.sit_id, m.text, coalesce(m.id, n.id) AS id FROM matched m LEFT JOIN near n ON n.sit_id = m.sit_id AND n.r = 1),
v AS (SELECT sit_id, m.id, c.*, CASE WHEN m.id IS NOT NULL THEN {_VALUE.replace('text', 'm.text')} END AS value FROM chosen m LEFT JOIN criteria c USING (id)), w AS (SELECT *, {_OK} AS ok FROM v)
SELECT sit_id, coalesce(id, '') AS criterion_id, CASE WHEN id IS NULL THEN 'no_match' WHEN value IS NULL THEN 'insufficient_info' WHEN ok THEN 'pass' ELSE 'fail' END AS verdict, value FROM w""")
def compliance_vectors(spark, d):
    """Situations without a rule's keywords get the rule whose topic is near."""
    return rules.verdicts(X.near_situations(spark, d), X.criteria(spark), vectors=True).select("sit_id", "criterion_id", "verdict", "value")


# --- evaluation -------------------------------------------------------------------------------------------

_ABLATION = f"""{X.HALVES_SQL}, {_BASE.replace("SELECT item_id, text, list_distinct", "SELECT item_id, text, truth, tier, list_distinct").replace("FROM benchmark)", "FROM halves)")}, runs AS (SELECT 'bm25_only' AS strategy, item_id, doc_id, rank FROM bm25 WHERE rank <= 5 UNION ALL SELECT 'dense_only', item_id, doc_id, rank FROM dense WHERE rank <= 5
UNION ALL SELECT 'hybrid', item_id, doc_id, rank FROM fused WHERE rank <= 8 UNION ALL SELECT 'hybrid_rerank', item_id, doc_id, rank FROM reranked WHERE rank <= 8),
judged AS (SELECT strategy, item_id, rank, {_F1} >= 0.15 AS relevant FROM (SELECT r.*, list_distinct({_TOKENS.replace("coalesce(text", "coalesce(q.truth")}) AS a, list_distinct(d.tokens) AS b FROM runs r JOIN q USING (item_id) JOIN d USING (doc_id))),
firsts AS (SELECT strategy, item_id, min(rank) FILTER (relevant) AS first FROM judged GROUP BY ALL),
metrics AS (SELECT s.strategy, count(*) AS n_items, round(avg(CASE WHEN first IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 4) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr FROM (SELECT DISTINCT strategy FROM judged) s CROSS JOIN (SELECT item_id FROM q) i LEFT JOIN firsts f ON f.strategy = s.strategy AND f.item_id = i.item_id GROUP BY s.strategy)"""


def _judged(spark, d):
    """Questions that are the beginning of a passage, results judged by the rest of it."""
    q, docs = X.halves(spark, d), retrieval.corpus(X.table(spark, d, "documents"))
    return evaluate.relevance(retrieval.ablation(q.select("item_id", "text"), docs), q.select("item_id", "truth"), docs), q


def _metrics(spark, d):
    return evaluate.hit_rate_and_mrr(*_judged(spark, d))


@query(f"WITH {_ABLATION}, t AS (SELECT strategy, tier, count(first) AS hits, sum(coalesce(1.0::DOUBLE / first, 0)) AS ranks FROM firsts JOIN q USING (item_id) GROUP BY ALL) SELECT strategy, tier, n_items, round(hits / n_items, 4) AS hit_rate, round(ranks / n_items, 4) AS mrr FROM t JOIN (SELECT tier, count(*) AS n_items FROM q GROUP BY tier) USING (tier)")
def eval_by_tier(spark, d):
    return evaluate.by_tier(*_judged(spark, d))


@query(f"WITH {_ABLATION} SELECT strategy, n_items, hit_rate, mrr FROM metrics")
def eval_hit_rate_mrr(spark, d):
    return _metrics(spark, d)


@query(f"""WITH {_ABLATION}, v AS (SELECT max(mrr) FILTER (strategy = 'bm25_only') AS b, max(mrr) FILTER (strategy = 'dense_only') AS e, max(mrr) FILTER (strategy = 'hybrid') AS h, max(mrr) FILTER (strategy = 'hybrid_rerank') AS r FROM metrics),
p AS (SELECT unnest(['dense_vs_bm25', 'hybrid_vs_dense', 'rerank_vs_hybrid', 'rerank_vs_dense']) AS delta, unnest([b, e, h, e]) AS x, unnest([e, h, r, r]) AS y FROM v)
SELECT delta, CASE WHEN x <> 0 AND y <> 0 THEN round((y - x) / x * 100, 1) END AS pct FROM p""")
def eval_ablation_delta(spark, d):
    return evaluate.deltas(_metrics(spark, d), "mrr")


@query(f"""WITH {_ABLATION}, n AS (SELECT strategy, item_id, count(*) AS n FROM runs GROUP BY ALL) SELECT s.strategy, round(avg(coalesce(n, 0)), 1) AS avg_chunks, count(*) FILTER (coalesce(n, 0) > 0) AS items_with_context
FROM (SELECT DISTINCT strategy FROM runs) s CROSS JOIN (SELECT item_id FROM q) i LEFT JOIN n ON n.strategy = s.strategy AND n.item_id = i.item_id GROUP BY s.strategy""")
def eval_context_counts(spark, d):
    q, docs = X.halves(spark, d).select("item_id", "text"), retrieval.corpus(X.table(spark, d, "documents"))
    return evaluate.context_counts(retrieval.ablation(q, docs), q)


_JUDGED = ", ".join(f"{x} AS {m}" for m, x in X.JUDGED.items())


@query(f"WITH j AS (SELECT {_JUDGED} FROM benchmark) SELECT " + ", ".join(f"coalesce(round(avg(round({m}, 4)) FILTER (NOT isnan({m})), 4), 'NaN'::DOUBLE) AS {m}" for m in X.JUDGED) + " FROM j")
def eval_judge_means(spark, d):
    return evaluate.judge_means(X.judged(spark, d), list(X.JUDGED))


_AT = _TOKENS.replace("coalesce(text", "coalesce(answer")
_TT = _TOKENS.replace("coalesce(text", "coalesce(truth")


_UNIT = _BASE[_BASE.index("hashed AS"):_BASE.index(",\ndense AS")]


@query(f"""WITH {X.ANSWERS_SQL}, k AS (SELECT * FROM answers WHERE NOT starts_with(lower(truth), 'câu hỏi') AND answer <> '' AND truth <> ''), p AS (SELECT list_distinct({_AT}) AS a, list_distinct({_TT}) AS b FROM k),
words AS (SELECT 'a' AS side, item_id AS id, unnest({_AT}) AS term FROM k UNION ALL SELECT 't', item_id, unnest({_TT}) FROM k), {_UNIT},
n AS (SELECT id FROM unit GROUP BY id HAVING count(DISTINCT side) = 2), c AS (SELECT n.id, coalesce(sum(x.w * y.w), 0) AS c FROM n LEFT JOIN unit x ON x.id = n.id AND x.side = 'a' LEFT JOIN unit y ON y.id = n.id AND y.side = 't' AND y.dim = x.dim GROUP BY n.id)
SELECT count(*) AS n, round(avg({_F1}), 4) AS token_f1, (SELECT round(avg(c), 4) FROM c) AS semantic FROM p""")
def eval_token_f1(spark, d):
    """Mean token F1 and mean cosine of answers and truths."""
    return evaluate.correctness(X.answers(spark, d))


@query(f"WITH {X.ANSWERS_SQL} SELECT item_id, list_filter([answer, truth], lambda c: regexp_matches(c, '\\[1\\]')) AS contexts FROM answers WHERE len(list_filter([answer, truth], lambda c: regexp_matches(c, '\\[1\\]'))) > 0")
def judged_rows(spark, d):
    """The rows that judge metrics are asked for: those with any context."""
    rows = X.answers(spark, d).select("item_id", F.filter(F.array("answer", "truth"), lambda c: c.contains("[1]")).alias("contexts"))
    return evaluate.with_context(rows)


@query(f"""WITH {X.ANSWERS_SQL}, r AS (SELECT regexp_matches(answer, '\\S') AS filled, regexp_matches(answer, '{T.CITED}') AS cited, starts_with(lower(truth), 'câu hỏi') AS outside, regexp_matches(answer, '(?i){"|".join(T.REFUSALS)}') AS refused FROM answers)
SELECT round(coalesce(avg(cited::INT) FILTER (filled), 0), 4) AS citation_rate, round(avg(refused::INT) FILTER (outside), 4) AS refusal_rate, count(*) FILTER (filled) AS n_answers, count(*) FILTER (outside) AS n_outside FROM r""")
def eval_answer_rates(spark, d):
    return evaluate.answer_rates(X.answers(spark, d))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 1) AS mean, round(median(value), 1) AS median, round(list_sort(list(value))[least(floor(count(*) * 0.95), count(*) - 1)::INT + 1], 1) AS p95, round(min(value), 1) AS least, round(max(value), 1) AS most FROM events GROUP BY event_type""")
def eval_latency_stats(spark, d):
    return evaluate.latency(X.table(spark, d, "events"), "value", "event_type")


# --- logs and sessions ----------------------------------------------------------------------------------------


@query("SELECT count(*) FILTER (event_type <> 'error') AS total_queries, round(coalesce(avg(value) FILTER (event_type <> 'error' AND value > 0), 0), 1) AS avg_latency_ms, count(DISTINCT user_id) FILTER (event_type <> 'error') AS active_sessions FROM events")
def log_metrics(spark, d):
    return logs.metrics(X.table(spark, d, "events"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN (ts::VARCHAR)[1:19] ELSE strftime(ts, '%d/%m %H:%M:%S') END AS shown FROM events")
def short_timestamps(spark, d):
    """Events' times as the history shows them; those of errors are not in ISO form."""
    stamp = F.col("ts").cast("timestamp_ntz").cast("string")
    rows = X.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", stamp).otherwise(F.replace(stamp, F.lit(" "), F.lit("T"))).alias("stamp"))
    return rows.select("event_id", T.short_timestamp(F.col("stamp")).alias("shown"))


@query("""WITH l AS (SELECT conv_id, coalesce(list(text ORDER BY turn) FILTER (role = 'user'), []) AS q, coalesce(list(text ORDER BY turn) FILTER (role = 'assistant'), []) AS a, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
n AS (SELECT *, unnest(range(1, least(len(q), len(a), len(t)) + 1)) AS pos FROM l) SELECT conv_id, pos::INT AS pos, q[pos] AS question, a[pos] AS answer, t[pos] AS truth FROM n""")
def zipped_lists(spark, d):
    """Parallel lists of a conversation put together by position, as long as the shortest; a conversation's lists are rows of its own."""
    texts = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.lit(True) if role is None else F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    lists = X.table(spark, d, "conversations").groupBy("conv_id").agg(texts("user").alias("q"), texts("assistant").alias("a"), texts(None).alias("t"))
    rows = lists.select("conv_id", F.posexplode(evaluate.zipped(F.col("q"), F.col("a"), F.col("t"))).alias("pos", "z"))
    return rows.select("conv_id", (F.col("pos") + 1).alias("pos"), F.col("z.question"), F.col("z.answer"), F.col("z.truth"))


@query("SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error') AS queries, CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*) FILTER (event_type <> 'error'), 4) ELSE 0.0 END AS error_rate FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE")
def error_rate_trailing(spark, d):
    return logs.error_rate(X.table(spark, d, "events"))


@query("SELECT event_id, recent, recent > 2 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events)")
def rate_limit_flags(spark, d):
    """Hourly, since the events lie far apart."""
    return logs.rate_limited(X.table(spark, d, "events"), 2, 3600).select("event_id", "recent", "limited")


_ADMIT = """WITH e AS (SELECT user_id, list({{'event_id': event_id, 't': epoch_us(ts), 'bad': event_type = 'error', 'win': []::BIGINT[], 'failed': 0, 'out': []::STRUCT(event_id BIGINT, pair INT, recent INT, failed_run INT)[]}} ORDER BY ts, event_id) AS es FROM events GROUP BY user_id),
r AS (SELECT list_reduce(list_prepend({{'event_id': -1::BIGINT, 't': 0::BIGINT, 'bad': false, 'win': []::BIGINT[], 'failed': 0, 'out': []::STRUCT(event_id BIGINT, pair INT, recent INT, failed_run INT)[]}}, es), lambda a, x: {{'event_id': x.event_id, 't': x.t, 'bad': x.bad,
'win': CASE WHEN {ok} THEN list_append({kept}, x.t) ELSE {kept} END, 'failed': CASE WHEN NOT ({ok}) THEN a.failed WHEN x.bad THEN a.failed + 1 ELSE 0 END,
'out': list_append(a.out, {{'event_id': x.event_id, 'pair': CASE WHEN {ok} THEN 0 END, 'recent': CASE WHEN {ok} THEN len({kept})::INT + 1 END, 'failed_run': CASE WHEN {ok} THEN CASE WHEN x.bad THEN a.failed + 1 ELSE 0 END END}})}}) AS s FROM e)
SELECT unnest(s.out, recursive := true) FROM r"""
_KEPT = "list_filter(a.win, lambda t: t > x.t - {seconds} * 1000000::BIGINT)"


def _admit(most: int, seconds: int) -> str:
    kept = _KEPT.format(seconds=seconds)
    return _ADMIT.format(kept=kept, ok=f"a.failed < 3 AND len({kept}) < {most}")


@query(_admit(10, 61))
def admission_sliding_61s(spark, d):
    return logs.admitted(X.table(spark, d, "events"))


@query(_admit(2, 2_592_000))
def admission_sliding_month(spark, d):
    """Two calls in 30 days, since the events lie far apart: refused calls fill no window."""
    return logs.admitted(X.table(spark, d, "events"), 2, 2_592_000)


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 20")
def session_last20(spark, d):
    return logs.last_messages(X.table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, coalesce(history, '') AS history FROM (SELECT conv_id, turn, role, string_agg(role || ': ' || text[1:800], chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history FROM conversations) WHERE role = 'user'")
def history_last6(spark, d):
    return logs.histories(X.table(spark, d, "conversations"))


@query(f"""WITH {_BASE}, g AS (SELECT f.item_id, o.source AS name, count(*) AS n, min(f.rank) AS first FROM fused f JOIN documents o USING (doc_id) WHERE f.rank <= 8 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY first) AS r FROM g) SELECT item_id, string_agg(name || ' (' || n || ' đoạn)', ', ' ORDER BY r) AS summary FROM r WHERE r <= 3 GROUP BY item_id""")
def doc_hit_summary_top3(spark, d):
    names = X.table(spark, d, "documents").select("doc_id", F.col("source").alias("name"))
    return logs.hit_summary(retrieval.hybrid(*_asked(spark, d)), names)


@query("SELECT user_id AS grp, CASE WHEN bool_and(h) THEN 'ok' WHEN bool_or(h) THEN 'degraded' ELSE 'error' END AS status FROM (SELECT user_id, event_type <> 'error' AS h FROM events) GROUP BY user_id")
def health_rollup(spark, d):
    return logs.health(X.table(spark, d, "events").select(F.col("user_id").alias("grp"), (F.col("event_type") != "error").alias("healthy")))


@query("SELECT conv_id, turn, text[1:500] AS query, reverse(text)[1:300] AS answer_snippet FROM conversations")
def query_log_rows(spark, d):
    return logs.query_log(X.table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"), F.reverse("text").alias("answer_snippet")))


_WINDOWS = """WITH w AS (SELECT ts, event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') - INTERVAL 30 MINUTE]) AS window_start FROM events)
SELECT window_start, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type <> 'error') AS queries, CASE WHEN count(*) FILTER (event_type <> 'error') > 0 THEN round(count(*) FILTER (event_type = 'error')::DOUBLE / count(*) FILTER (event_type <> 'error'), 4) ELSE 0.0 END AS error_rate FROM w GROUP BY window_start"""


@query(_WINDOWS)
def error_windows(spark, d):
    return logs.error_windows(X.table(spark, d, "events"))


@query(_WINDOWS)
def stream_error_windows(spark, d):
    """The same over a stream, replayed to its end."""
    from siltstone.streaming.replay import replayed

    rows = replayed(spark, f"{d}/events.parquet", lambda s: logs.error_windows(s.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days")), "complete")
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 20 GROUP BY conv_id")
def stream_session_state(spark, d):
    """Bounded state of every session (20 messages), kept by a stateful stream."""
    from siltstone.streaming.sessions import session_state

    return session_state(spark, f"{d}/conversations.parquet")


@query("SELECT event_id, least(recent, 3)::INT AS recent, recent > 2 AS limited FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events)")
def stream_rate_limit(spark, d):
    """The rate limiter as a stream; its state holds two requests and the one at hand."""
    from siltstone.streaming.limits import limits

    return limits(spark, f"{d}/events.parquet", 2, 3600)
