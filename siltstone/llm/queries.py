"""The queries of this package for __spark_entry__.py, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.quality import quality

    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.embedding_dedup import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.sentencepiece_codec import encode, model_bytes

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(documents.select("doc_id", "text"), model_bytes(), keep=["doc_id"], check=True)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.mixing import mix

    documents, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.warc import round_trip

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return round_trip(spark, pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.ngram_join import near_texts

    return near_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.language_id import language_id

    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.url_filter import url_filter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.hmm_lm import lm_scores

    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.exact_dedup import exact_dedup

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(documents).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.html_extraction import main_texts

    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "consensus")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.divergence import divergences

    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siltstone.llm.conversation_repair import repair_audit

    return repair_audit(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_embedding_dedup, op3_sentencepiece, op4_mixing, op5_warc, op6_ngram_join, op7_language_id, op8_url_filter, op9_lm_scoring, op10_exact_dedup, op11_html_extraction, op12_divergence, op13_conversation_repair)}

_CLOSED = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b), part AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""

SQL = {
    "op2_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), nodes AS (SELECT id FROM v),
        edges AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.label = q.label AND p.id <> q.id WHERE list_cosine_similarity(p.x, q.x) >= 0.93), {_CLOSED}
        SELECT id AS vec_id, count(b) AS n_links, any_value(component_id) AS component_id, id = any_value(component_id) AS kept FROM part LEFT JOIN edges ON a = id GROUP BY id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, h, octet_length(encode(h)) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p),
        b AS (SELECT *, array_to_string(list_transform(string_split(s, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS bits FROM d)
        SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::INT, 1)), '') AS payload_digest,
        CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM b""",
    "op6_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), nodes AS (SELECT id FROM w),
        s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
        n AS (SELECT id, count(*) AS n FROM s GROUP BY id), common AS (SELECT p.id AS a, q.id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.id <> q.id GROUP BY ALL),
        edges AS (SELECT a, b FROM common JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {_CLOSED}
        SELECT id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM part LEFT JOIN n USING (id)""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op12_divergence": """
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS l, coalesce(source, '') AS s, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        t AS (SELECT id, l, s, unnest(w) AS t FROM d), k AS (SELECT l, t FROM t GROUP BY l, t HAVING count(DISTINCT id) >= 30), g AS (SELECT DISTINCT l, s FROM d),
        c AS (SELECT l, s, t, count(*) AS c FROM t JOIN k USING (l, t) GROUP BY l, s, t),
        x AS (SELECT g.l, g.s, k.t, coalesce(c.c, 0)::HUGEINT AS c FROM g JOIN k ON k.l = g.l LEFT JOIN c ON c.l = g.l AND c.s = g.s AND c.t = k.t),
        p AS (SELECT l, s, t, c, (1 + (1000000000 * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w))::BIGINT AS p FROM x WINDOW w AS (PARTITION BY l, s)),
        y AS (SELECT l, t, sum(c) AS c FROM x GROUP BY l, t), q AS (SELECT l, t, (1 + (1000000000 * (c + 5)) // (sum(c) OVER w + 5 * count(*) OVER w))::BIGINT AS q FROM y WINDOW w AS (PARTITION BY l)),
        pairs AS (SELECT a.l, a.s, b.s AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.l = b.l AND a.t = b.t AND a.s <> b.s GROUP BY a.l, a.s, b.s),
        r AS (SELECT a.l AS lang, a.s AS source, 'pair' AS part, b.s AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.l = b.l AND a.s <> b.s LEFT JOIN pairs ON pairs.l = a.l AND pairs.s = a.s AND pairs.item = b.s
              UNION ALL SELECT p.l, p.s, 'term', p.t, p.p - q.q FROM p JOIN q USING (l, t) WHERE p.c > 0 AND p.p > q.q),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
        SELECT lang, source, part, item, value, rank::INT AS rank FROM z WHERE part = 'pair' OR rank <= 50""",
}
