"""The engine as one object over a folder of tables: ingest, ask, report, evaluate, watch.

Chunks are kept in `chunks` (chunk_id, doc_id: the chunk's number for retrieval, text, header, title, url, so_hieu, doc_type, source),
their words in `index` (operators.segments), questions and answers in `query_log`, refused ones in `error_log`, uploads in `upload_log`. Models stay ports: give
`retrieve`, `embed`, `rerank`, `judge`, `label`, `rewrite`, `extract` or `generate` to replace the defaults.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import answer, chunk, evaluate, logs, retrieval, rules, segments, tables, tools
from siltstone.sources import readers, sinks


class Engine:
    def __init__(
        self, spark: SparkSession, root: str, retrieve: Callable | None = None, criteria: DataFrame | None = None, embed: Callable = retrieval.embedded,
        rerank: Callable | None = None, extract: Callable | None = None, mode: str = "hybrid",
    ):
        """retrieve: (questions, docs) -> ranked results; without one, fusion over the stored index (mode: hybrid, or one of dense and bm25
        where the other isn't to be had), reranked by `rerank` if that is given. extract: see rules.verdicts."""
        self.spark, self.root, self.criteria, self.embed, self.extract = spark, root.rstrip("/"), criteria, embed, extract
        self.retrieve = retrieve or self._stored
        self.index = segments.Index(spark, f"{self.root}/index")
        self.rerank, self.mode = rerank, mode

    def _stored(self, questions: DataFrame, docs: DataFrame, k: int = retrieval.TOP) -> DataFrame:
        options = {"embed": self.embed, "index": self.index if self.index.state().generations else None, "mode": self.mode}
        if self.rerank is None:
            return retrieval.hybrid(questions, docs, k, **options)
        return retrieval.hybrid_reranked(questions, docs, k, self.rerank, **options)

    # --- documents ---------------------------------------------------------------------------------

    def _chunked(self, documents: DataFrame) -> DataFrame:
        key = F.coalesce(F.nullif("so_hieu", F.lit("")), F.nullif("url", F.lit("")), "title")
        rows = documents.withColumn("key", key).withColumn("doc_id", F.xxhash64("key"))
        made = chunk.valid(chunk.chunks(rows.select("doc_id", F.col("content").alias("text"))))
        meta = rows.select("doc_id", "key", "title", "url", "doc_type", "source", "so_hieu", "ngay_ban_hanh").dropDuplicates(["doc_id"])
        made = chunk.with_ids(made.join(meta, "doc_id"), "key")
        out = made.select("chunk_id", F.xxhash64("chunk_id").alias("doc_id"), "key", "chunk_index", "text", "header", "clause_count", "char_count", "title", "url", "doc_type", "source", "so_hieu", "ngay_ban_hanh")
        return tables.cut(out.dropDuplicates(["chunk_id"]))

    def ingest(self, documents: DataFrame, batch: str | None = None) -> None:
        """Chunks documents (title, content, url, doc_type, source, so_hieu, ngay_ban_hanh) and writes them by chunk_id; a second time changes nothing. batch: a
        name under which the index takes them once."""
        made = self._chunked(documents)
        sinks.save_new(made, f"{self.root}/chunks", "chunk_id")
        self.index.apply(batch or uuid.uuid4().hex, made.select("doc_id", "text"), new_only=True)

    def replace(self, documents: DataFrame, batch: str | None = None) -> None:
        """Documents in the place of those with their keys: chunks that are no longer there go, from the index first, so that a call that broke off can be made again."""
        made = self._chunked(documents)
        keys = documents.select(F.coalesce(F.nullif("so_hieu", F.lit("")), F.nullif("url", F.lit("")), "title").alias("key")).distinct()
        self._changed(self.chunks().join(keys, "key", "left_semi").join(made.select("chunk_id"), "chunk_id", "left_anti"), made, batch)

    def delete(self, keys: DataFrame, batch: str | None = None) -> None:
        """Takes the documents with these keys (key) out."""
        self._changed(self.chunks().join(keys.select("key").distinct(), "key", "left_semi"), None, batch)

    def _changed(self, gone: DataFrame, made: DataFrame | None, batch: str | None) -> None:
        gone = tables.cut(gone.select("doc_id", "chunk_id"))
        self.index.apply(batch or uuid.uuid4().hex, None if made is None else made.select("doc_id", "text"), gone.select("doc_id"))
        rows = self.chunks().join(gone.select("chunk_id"), "chunk_id", "left_anti")
        if made is not None:
            rows = rows.unionByName(tables.new_rows(made, rows, "chunk_id"))
        sinks.replaced(rows, f"{self.root}/chunks")

    def follow(self, stream: DataFrame, checkpoint: str):
        """Ingests the documents of a stream as they come, each batch once."""
        put = lambda batch, number: self.ingest(batch, f"{checkpoint}:{number}")
        return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()

    def upload(self, files: DataFrame, most: int = readers.PDF_MOST) -> DataFrame:
        """Ingests PDF uploads (filename, mime, length, content) that are let in, logs all of them, and gives (filename, refusal)."""
        judged = tables.cut(readers.uploads(files, most))
        let_in = judged.where("refusal is null").select(F.col("filename").alias("path"), "content")
        self.ingest(readers.extracted(let_in, readers.pdf_text, "upload"))
        rows = logs.upload_log(judged.select("filename", "length", "refusal", F.current_timestamp().alias("created_at")))
        rows.write.mode("append").parquet(f"{self.root}/upload_log")
        return judged.select("filename", "refusal")

    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/chunks")

    def list_documents(self) -> DataFrame:
        """key, title, url, doc_type and number of chunks of each document."""
        return self.chunks().groupBy("key", "title", "url", "doc_type").agg(F.count("*").alias("n_chunks"))

    def reset(self) -> None:
        from pyspark.errors import AnalysisException

        try:
            self.chunks().limit(0).write.mode("overwrite").parquet(f"{self.root}/chunks.empty")
        except AnalysisException:
            return
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = p(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(p(f"{self.root}/chunks"), True)
        fs.delete(p(f"{self.root}/index"), True)
        fs.rename(p(f"{self.root}/chunks.empty"), p(f"{self.root}/chunks"))

    # --- questions -----------------------------------------------------------------------------------

    def screened(self, questions: DataFrame) -> DataFrame:
        """questions (item_id, session_id, text) with text stripped and refusal: why a request isn't answered, null if it is."""
        guard = T.injection(T.stripped(F.col("text")))
        rows = questions.withColumn("refusal", T.rejection(F.col("text"), F.col("session_id"))).withColumn("g", guard)
        return rows.withColumn("refusal", F.coalesce("refusal", F.when(F.col("g.blocked"), F.concat(F.lit("guard:"), "g.category")))).withColumn("text", T.stripped(F.col("text"))).drop("g")

    def ask(
        self, questions: DataFrame, generate: Callable | None = None, judge: Callable | None = None, gate: float = 0.0,
        history: DataFrame | None = None, rewrite: Callable | None = None, label: Callable | None = None, reformulate: Callable | None = None,
    ) -> DataFrame:
        """(item_id, intent, query, retries, grade, answer, sources, invalid, latency_ms): cited answers of questions (item_id, session_id, text), each
        sent where its intent goes; what a node finds nothing for is retrieved and answered. Ports: generate takes (item_id, prompt or query,
        context) rows and gives (item_id, answer), without one answers are extracts; rewrite gives (item_id, query) of (item_id, query, history)
        rows for questions with a history (item_id, history); label gives (item_id, label) of the questions whose keywords tell nothing;
        reformulate: see answer.retried."""
        began, docs = time.time(), self.chunks()
        asked = self.screened(questions).where("refusal is null")
        if history is not None and rewrite is not None:
            before = asked.select("item_id", F.col("text").alias("query")).join(history.where("history <> ''"), "item_id")
            asked = asked.join(rewrite(before).select("item_id", F.col("query").alias("said")), "item_id", "left").withColumn("text", F.coalesce(F.nullif(T.stripped(F.col("said")), F.lit("")), "text")).drop("said")
        if label is not None:
            open_ = asked.where((T.intent(F.col("text")) == "simple_qa") & (T.word_count(F.col("text")) > 6))
            asked = asked.join(label(open_.select("item_id", "text")).select("item_id", "label"), "item_id", "left")
        else:
            asked = asked.withColumn("label", F.lit(None).cast("string"))
        asked = tables.cut(asked.withColumn("intent", tools.labelled(F.col("label"), F.col("text"))).withColumn("node", tools.route(F.col("intent"))))
        done = self._nodes(asked, docs, generate)
        rest = asked.join(done.select("item_id"), "item_id", "left_anti")
        rows = self._answered(rest, docs, generate, judge, gate, reformulate)
        named = done.join(asked.select("item_id", "intent", F.col("text").alias("query")), "item_id").select("item_id", "intent", "query", F.lit(0).alias("retries"), "grade", "answer")
        return rows.unionByName(named, allowMissingColumns=True).withColumn("latency_ms", F.lit(int((time.time() - began) * 1000)).cast("long"))

    def _nodes(self, asked: DataFrame, docs: DataFrame, generate: Callable | None) -> DataFrame:
        """(item_id, grade, answer) of the questions that the nodes of their intents answer: rules, comparisons, summaries and reports."""
        of = lambda node: asked.where(F.col("node") == node).select("item_id", "text")
        chunks = docs.select("doc_id", "text", "title", "header", "url")
        compared = tools.compare(of("compare"), chunks, self.retrieve, generate).where("context_a <> '' or context_b <> ''")
        summed = tools.summarize(of("summarize"), chunks, self.retrieve, generate).where(~F.col("answer").startswith("Không tìm thấy văn bản: "))
        written = sinks.report_markdown(tools.report(of("report"), chunks, self.retrieve, generate).where("section <> 'summary' or body not like 'Không tìm thấy văn bản: %'"))
        found = written.join(tools.search(of("report"), chunks, self.retrieve).select("item_id").distinct(), "item_id", "left_semi").select("item_id", F.col("report").alias("answer"))
        out = compared.select("item_id", F.lit("compare").alias("grade"), "answer").unionByName(summed.select("item_id", F.lit("summary").alias("grade"), "answer")).unionByName(found.select("item_id", F.lit("report").alias("grade"), "answer"))
        if self.criteria is not None:
            verdicts = rules.verdicts(of("compliance").withColumnRenamed("item_id", "sit_id"), self.criteria, vectors=True, embed=self.embed, extract=self.extract)
            ruled = rules.rendered(verdicts.where("verdict in ('pass', 'fail')"))
            out = out.unionByName(ruled.select(F.col("sit_id").alias("item_id"), F.lit("rule").alias("grade"), "answer"))
        return tables.cut(out)

    def _answered(self, rest: DataFrame, docs: DataFrame, generate: Callable | None, judge: Callable | None, gate: float, reformulate: Callable | None) -> DataFrame:
        texts = docs.select("doc_id", "text")
        tries = answer.retried(rest.select("item_id", "text"), texts, self.retrieve, gate, judge, reformulate)
        found = tables.cut(answer.gated(self.retrieve(tries.select("item_id", F.col("query").alias("text")), texts), gate))
        shown = answer.context(found, texts)
        if generate is None:
            replies = answer.extractive(found, docs.select("doc_id", "text", "title"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Văn bản pháp luật")))
        else:
            block = answer.joined(shown, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "shown"), "\n\n---\n\n", "context")
            replies = generate(tries.select("item_id", "query").join(block, "item_id").withColumn("prompt", F.concat("context", F.lit("\n\n"), "query"))).select("item_id", "answer")
        n = found.groupBy("item_id").agg(F.count("*").cast("int").alias("n"))
        label = T.citation_label(F.col("so_hieu"), F.col("title"), F.col("header"), F.col("url"))
        meta = F.struct("title", "header", "url", "so_hieu", "doc_type", "source")
        cited = answer.cited(replies, found).join(docs.select("doc_id", label.alias("label"), meta.alias("meta")), "doc_id")
        cited = cited.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "score", "meta"))).alias("sources"))
        out = tries.join(replies, "item_id", "left").join(n, "item_id", "left").join(cited, "item_id", "left").join(rest.select("item_id", "intent"), "item_id")
        count = F.coalesce("n", F.lit(0))
        return out.select("item_id", "intent", "query", "retries", "grade", T.citations_cleaned(F.col("answer"), count).alias("answer"), "sources", T.invalid_citations(F.col("answer"), count).alias("invalid"))

    def log(self, questions: DataFrame, answers: DataFrame) -> None:
        """Appends answered questions to the query log and refused ones to the error log."""
        screened = self.screened(questions)
        latency = F.col("latency_ms") if "latency_ms" in answers.columns else F.lit(0).cast("long")
        rows = screened.join(answers.select("item_id", "answer", latency.alias("latency_ms")), "item_id").select("session_id", F.col("text").alias("query"), F.col("answer").alias("answer_snippet"), "latency_ms", F.current_timestamp().alias("created_at"))
        logs.query_log(rows).write.mode("append").parquet(f"{self.root}/query_log")
        self.log_errors(screened.where("refusal is not null").select("session_id", F.lit("query").alias("endpoint"), F.split("refusal", ":")[0].alias("error_type"), F.col("refusal").alias("message")))

    def log_errors(self, rows: DataFrame) -> None:
        """Appends errors (session_id, endpoint, error_type, message), without secrets."""
        rows.select("session_id", "endpoint", "error_type", T.redacted(F.col("message")).alias("message"), F.current_timestamp().alias("created_at")).write.mode("append").parquet(f"{self.root}/error_log")

    def search(self, questions: DataFrame, k: int = 5) -> DataFrame:
        docs = self.chunks().select("doc_id", "text")
        return retrieval.hits(self.retrieve(questions.select("item_id", "text"), docs).where(F.col("rank") <= k), docs)

    def report(self, questions: DataFrame, title: str) -> DataFrame:
        docs = self.chunks().select("doc_id", "text")
        return sinks.report_sections(self.retrieve(questions.select("item_id", "text"), docs), docs, title)

    def tool(self, name: str, questions: DataFrame, **options) -> DataFrame:
        """One of tools.TOOLS over the store."""
        return tools.TOOLS[name](questions, self.chunks().select("doc_id", "text", "title", "header", "url"), self.retrieve, **options)

    # --- quality and health ---------------------------------------------------------------------------

    def evaluate(self, items: DataFrame, strategies=tuple(retrieval.STRATEGIES), generate: Callable | None = None, cache: str | None = None, judge: Callable | None = None) -> DataFrame:
        """(strategy, n_items, hit_rate, mrr, avg_chunks, items_with_context) of items (item_id, question, truth); those outside the corpus don't count. With
        generate also token_f1 and semantic of its answers, which are kept in the folder cache and taken from there when the same questions come again. With judge, a port that
        gives evaluate.JUDGED of (item_id, question, answer, contexts, truth) rows with any context, also their means over the rows scored, and passed: whether the targets are reached."""
        docs = self.chunks().select("doc_id", "text")
        kept = items.where(~T.is_out_of_corpus(F.col("truth")))
        q = kept.select("item_id", F.col("question").alias("text"))
        found = tables.cut(retrieval.ablation(q, docs, strategies))
        out = evaluate.hit_rate_and_mrr(evaluate.relevance(found, kept.select("item_id", "truth"), docs), q).join(evaluate.context_counts(found, q), "strategy")
        if generate is None:
            return out
        scores = None
        for name in strategies:
            answers = sinks.cached_answers(self.spark, cache, name, q) if cache else None
            if answers is None:
                shown = answer.context(found.where(F.col("strategy") == name), docs)
                rows = answer.joined(shown, F.col("shown"), "\n\n", "context").join(q.withColumnRenamed("text", "query"), "item_id")
                answers = tables.cut(generate(rows.withColumn("prompt", F.concat("context", F.lit("\n\n"), "query"))).select("item_id", "answer"))
                if cache:
                    sinks.cache_answers(answers, cache, name, q)
            row = evaluate.correctness(answers.join(kept.select("item_id", "truth"), "item_id"), self.embed).select(F.lit(name).alias("strategy"), "token_f1", "semantic")
            if judge is not None:
                row = row.join(sinks.judge_report(evaluate.judged(answers, kept, found.where(F.col("strategy") == name), docs, judge)).withColumn("strategy", F.lit(name)), "strategy")
            scores = row if scores is None else scores.unionByName(row)
        return out.join(scores, "strategy")

    def metrics(self) -> dict:
        """Numbers of queries, errors, sessions and chunks, mean latency, and errors per query in the last 60 minutes; zeros where a table isn't there yet."""
        there = {name: self.spark.read.parquet(f"{self.root}/{name}") for name in ("query_log", "error_log", "chunks") if sinks.exists(self.spark, f"{self.root}/{name}")}
        parts = []
        if "query_log" in there:
            parts.append(there["query_log"].select(F.col("created_at").alias("ts"), F.col("session_id").alias("user_id"), F.lit("query").alias("event_type"), F.col("latency_ms").cast("double").alias("value")))
        if "error_log" in there:
            parts.append(there["error_log"].select(F.col("created_at").alias("ts"), F.col("session_id").alias("user_id"), F.lit(logs.ERROR).alias("event_type"), F.lit(0.0).alias("value")))
        out = {"total_queries": 0, "avg_latency_ms": 0.0, "active_sessions": 0, "errors": 0, "error_rate": 0.0, "corpus_chunks": there["chunks"].count() if "chunks" in there else 0}
        if parts:
            events = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
            out |= logs.metrics(events).first().asDict()
            out["errors"] = events.where(F.col("event_type") == logs.ERROR).count()
            out["error_rate"] = logs.error_rate(events, now=events.select(F.current_timestamp()).first()[0]).first()["error_rate"]
        return out

    def health(self) -> str:
        """ok with chunks to answer from, else error: the store is the only service that the defaults need."""
        return "ok" if self.metrics()["corpus_chunks"] else "error"


SOURCES = {"parquet": lambda spark, path: readers.documents(spark.read.parquet(path)), "json": readers.json_files, "text": lambda spark, path: readers.documents(readers.text_files(spark, path), clean=False), "markdown": lambda spark, path: readers.documents(readers.text_files(spark, path, True), clean=False), "docx": readers.docx_files, "pdf": readers.pdf_files}
