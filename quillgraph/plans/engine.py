"""The facade: insert, query and delete over named tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import content_id
from quillgraph.operators import evidence, fusion, graph, ingest, scoring, store, vector
from quillgraph.session import materialise
from quillgraph.sources import tables
from quillgraph.streaming.metrics import Metrics, timed_udf


@dataclass
class QueryParam:
    mode: str = "hybrid"
    top_k: int = 60
    gate: float = 0.5
    ablation: str = "full"


class WatchedStore:
    """A store whose writes are timed and counted, and whose lost attempts count as retries."""

    def __init__(self, store, metrics: Metrics):
        self._store, self._metrics = store, metrics
        store.on_retry = lambda: metrics.count("retry_total", 1, "store")

    def __getattr__(self, name: str):
        found = getattr(self._store, name)
        if name not in ("upsert", "write", "delete"):
            return found

        def run(*args, **more):
            with self._metrics.timed("graph", name):
                return found(*args, **more)

        return run


class Engine:
    """Documents in, ranked knowledge out.

    embed turns a list of texts into vectors of ``dim`` numbers; complete turns
    a series of chunks into extraction records. Both run in Arrow batches on
    the executors; what they return is written before it is read twice.

    Optional parts: glean, a pair of functions of a series of histories (the
    chunk and all that was extracted): what is still missing, and whether to go
    on; summarise, of descriptions that have grown long; rerank, of two lists
    (questions, texts); scorer, the weights of a trained scoring.attention_score
    for a question and a hyperedge's members. resolve holds the thresholds of
    ingest.resolved (name cosine, Jaccard, overlap), None leaves names as they
    are. Tables belong to a workspace of the store.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable, dim: int, complete: Callable[[pd.Series], pd.Series], chunk: int = 1200, overlap: int = 100, *, workspace: str = "default", kind: str = "DeltaStore", glean: tuple[Callable, Callable] | None = None, summarise: Callable | None = None, rerank: Callable | None = None, scorer: dict | None = None, resolve: tuple[float, float, float] | None = (0.85, 0.25, 0.8)):
        self.spark, self.metrics = spark, Metrics()
        self.store = WatchedStore(tables.open_store(kind, spark, root, workspace), self.metrics)
        self.embed, self.complete = timed_udf(scoring.checked_embedder(embed, dim), "array<float>"), timed_udf(complete, "string")
        self.glean = glean and tuple(map(scoring.language_model_udf, glean))
        self.summarise, self.rerank = summarise and scoring.language_model_udf(summarise), rerank and scoring.reranker_udf(rerank)
        self.scorer, self.resolve, self.chunk, self.overlap = scorer, resolve, chunk, overlap

    def _embedded(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the vector of a column, computed once."""
        return self.metrics.called(df, "vector", self.embed, F.col(column), "embedding", lambda rows: materialise(rows, name))

    def _known(self, name: str, keys: DataFrame, on: str | list[str]) -> DataFrame | None:
        """Stored rows that new ones with these keys touch."""
        return self.store.read(name).join(keys, on, "left_semi") if self.store.exists(name) else None

    def _extracted(self, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hyperedges, entities) of chunks, with what gleaning adds."""
        done = self.metrics.called(chunks, "output", self.complete, F.col("content"), "llm", lambda rows: materialise(rows, "extracted"))
        if self.glean:
            proceed, more = ((lambda out, f=f: f(F.concat_ws("\n", "content", out))) for f in self.glean)
            done = materialise(done.withColumn("output", ingest.gleaned(F.col("output"), proceed, more)), "gleaned")
        edges, nodes = ingest.extraction(done)
        return materialise(edges, "edges"), materialise(nodes, "nodes")

    def _one_name(self, nodes: DataFrame) -> DataFrame:
        """nodes with the names that entities go by, in this batch and in the store."""
        least, jaccard, overlap = self.resolve
        vectors = self._embedded(nodes.select("entity").distinct(), "entity", "names")
        stored = incidence = hyperedges = None
        if self.store.exists("vec_entities") and self.store.exists("incidence"):
            stored = self.store.read("vec_entities").select(F.col("name").alias("entity"), "vector")
            incidence = self.store.read("incidence").select("hyperedge", "entity")
            old = self.store.read("vec_hyperedges").select(F.col("name").alias("hyperedge"), "vector")
            new = self._embedded(nodes.select("hyperedge").distinct().join(old, "hyperedge", "left_anti"), "hyperedge", "hyperedge-vectors")
            hyperedges = materialise(old.unionByName(new), "hyperedges")
        roots = ingest.resolved(nodes, vectors, stored, incidence, hyperedges, least, jaccard, overlap)
        renamed = nodes.join(roots, nodes["entity"] == roots["variant"], "left").withColumn("entity", F.coalesce("root", "entity"))
        return materialise(renamed.select(*nodes.columns), "resolved")

    def _add(self, edges: DataFrame, nodes: DataFrame) -> None:
        """Merges edges(hyperedge, weight, source_id) and nodes(hyperedge, entity, entity_type, description, role, weight, pos) with the stored rows that they touch."""
        old = self._known("hyperedges", edges.select("hyperedge").distinct(), "hyperedge")
        self.store.upsert("hyperedges", ingest.merge_hyperedges(edges, old), "hyperedge", "rows")
        inc = nodes.select("hyperedge", "entity", "role", "weight", F.lit(1).alias("_new"), "pos")
        before = self._known("incidence", nodes.select("hyperedge", "entity").distinct(), ["hyperedge", "entity"])
        if before is not None:
            first = F.struct(F.lit("").alias("chunk_id"), F.lit(0).alias("pos")).alias("pos")
            inc = before.select("hyperedge", "entity", "role", "weight", F.lit(0).alias("_new"), first).unionByName(inc)
        self.store.upsert("incidence", ingest.merge_incidence(inc.withColumn("pos", F.struct("_new", "pos"))), ["hyperedge", "entity"], "rows")
        known = self.store.read("entities") if self.store.exists("entities") else None
        merged = ingest.merge_entities(nodes, known).select("entity", "entity_type", "description")
        if self.summarise:
            merged = materialise(merged.withColumn("description", ingest.summarised(F.col("description"), self.summarise)), "summaries")
        self.store.upsert("entities", merged, "entity", "rows")
        self._embed("vec_hyperedges", "rel-", edges.select(F.col("hyperedge").alias("name"), F.col("hyperedge").alias("content")))
        self._embed("vec_entities", "ent-", nodes.select(F.col("entity").alias("name"), F.col("entity").alias("content")))

    def _embed(self, table: str, prefix: str, rows: DataFrame) -> None:
        """Vectors of rows(name, content) that have none yet."""
        rows = rows.dropDuplicates(["name"]).withColumn("id", content_id(prefix, F.col("name")))
        if self.store.exists(table):
            rows = rows.join(self.store.read(table).select("id"), "id", "left_anti")
        self.store.upsert(table, self._embedded(rows, "content", "vectors").select("id", "name", "vector"), "id")

    def insert(self, texts: DataFrame, paper: str | None = None) -> None:
        """New documents (by content) are chunked, extracted, resolved, merged and stored; known ones cost nothing."""
        docs = ingest.documents(texts)
        if self.store.exists("full_docs"):
            docs = store.missing_keys(docs, self.store.read("full_docs"), "doc_id")
        docs = materialise(docs, "new-docs")
        chunks = materialise(ingest.chunks(docs, self.chunk, self.overlap), "chunks")
        edges, nodes = self._extracted(chunks)
        if edges.isEmpty():
            return
        if self.resolve and not nodes.isEmpty():
            nodes = self._one_name(nodes)
        self._add(edges.select("hyperedge", "weight", F.col("chunk_id").alias("source_id")), nodes.withColumn("pos", F.struct("chunk_id", "pos")))
        if paper:
            own = edges.select("hyperedge").distinct().select(F.concat(F.lit(f"{paper}|"), "hyperedge").alias("id"), F.lit(paper).alias("paper"), "hyperedge", F.lit("EVIDENCE").alias("role"), F.lit(1.0).alias("weight"))
            self.store.upsert("belongs", own, "id")
        self.store.upsert("text_chunks", chunks, "chunk_id")
        self.store.upsert("full_docs", docs, "doc_id")

    def _asked(self, questions: DataFrame) -> DataFrame:
        return self._embedded(questions.select("query_id", "text"), "text", "questions")

    def _entities_near(self, asked: DataFrame, k: int) -> DataFrame:
        found = vector.top_k(asked, self.store.read("vec_entities").select(F.col("name").alias("id"), "vector"), k)
        return materialise(found.select("query_id", F.col("id").alias("entity"), "similarity"), "near-entities")

    def _neural(self, asked: DataFrame, near: DataFrame) -> DataFrame:
        """(query_id, hyperedge, score) of the hyperedges that the entities of a question lead to, by the trained scorer."""
        incidence = self.store.read("incidence")
        reached = near.select("query_id", "entity").join(incidence.select("entity", "hyperedge"), "entity").select("query_id", "hyperedge").distinct()
        members = incidence.join(reached.select("hyperedge").distinct(), "hyperedge", "left_semi")
        tensors = graph.padded_tensor(members, self.store.read("vec_entities").select("name", "vector"))
        pairs = reached.join(tensors, "hyperedge").join(asked.select("query_id", "vector"), "query_id")
        return materialise(scoring.asked_scores(pairs, self.scorer), "neural")

    def query(self, questions: DataFrame, param: QueryParam | None = None) -> DataFrame:
        """(query_id, knowledge, coherence, rank) for questions(query_id, text): one plan for the whole batch.

        The vector stream orders what is near the question by the reranker, or
        by weight; the graph stream orders hyperedges of near entities by the
        trained scorer, or by similarity and idf; both are fused by their ranks.
        """
        param = param or QueryParam()
        if param.mode != "hybrid":
            raise ValueError("Only hybrid mode is supported currently.")
        if param.ablation not in ("full", "vector_only", "bm25_vector_only"):
            raise ValueError(f"unknown ablation: {param.ablation}")
        asked = self._asked(questions)
        found = vector.top_k(asked, self.store.read("vec_hyperedges").select(F.col("name").alias("id"), "vector"), param.top_k)
        hits = found.select("query_id", F.col("id").alias("hyperedge")).join(asked.select("query_id", "text"), "query_id")
        by_vector = evidence.vector_stream(hits, self.store.read("hyperedges"), param.top_k, self.rerank).select("query_id", "item", "rank")
        if param.ablation == "bm25_vector_only":
            texts = self.store.read("text_chunks").select(F.col("content").alias("item"), F.split("content", " ").alias("tokens"))
            out = evidence.bm25_and_vector(texts, questions.select("query_id", F.split("text", " ").alias("tokens")), by_vector, param.top_k)
            return out.select("query_id", F.col("item").alias("knowledge"), "coherence", "rank")
        if param.ablation == "vector_only":
            by_graph = by_vector.limit(0)
        else:
            near = self._entities_near(asked, param.top_k)
            if self.scorer:
                scores = self._neural(asked, near).filter("score > 0").withColumnRenamed("score", "s")
            else:
                incidence = self.store.read("incidence")
                scores = near.join(incidence, "entity").join(graph.idf(incidence), "entity").groupBy("query_id", "hyperedge").agg(F.sum(F.col("similarity") * F.col("idf_weight")).alias("s"))
            line = Window.partitionBy("query_id").orderBy(F.col("s").desc(), "hyperedge")
            ranked = scores.withColumn("rank", F.row_number().over(line) - 1).filter(F.col("rank") < param.top_k)
            by_graph = ranked.select("query_id", F.regexp_replace("hyperedge", "^<hyperedge>", "").alias("item"), "rank")
        out = fusion.weighted_fusion(by_vector, by_graph, param.gate, param.top_k)
        return out.select("query_id", F.col("item").alias("knowledge"), "coherence", "rank")

    def answer(self, questions: DataFrame, param: QueryParam | None = None) -> DataFrame:
        """What ``query`` gives, executed and kept, as one query of the metrics."""
        with self.metrics.timed("aquery"):
            return materialise(self.query(questions, param), "answers")

    def context(self, questions: DataFrame, top_k: int = 60) -> DataFrame:
        """(query_id, paper, tier, coverage, n_hyperedges, rank, text): the papers that a question's entities lead to, their best paths as text.

        Without a trained scorer a hyperedge scores the idf of its entities, as a share of the largest sum of all.
        """
        asked = self._asked(questions)
        near, incidence = self._entities_near(asked, top_k), self.store.read("incidence")
        if self.scorer:
            scores = self._neural(asked, near)
        else:
            weights = incidence.join(graph.idf(incidence), "entity").groupBy("hyperedge").agg(F.sum("idf_weight").alias("w"))
            scores = weights.crossJoin(F.broadcast(weights.agg(F.max("w").alias("m")))).select("hyperedge", F.round(F.col("w") / F.col("m"), 4).alias("score"))
        return evidence.graph_stream(near.select("query_id", "entity"), incidence, self.store.read("belongs").select("paper", "hyperedge"), scores)

    def insert_graph(self, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> None:
        """A given graph, see ingest.custom_graph for what is missing in it: a relation becomes a hyperedge with both ends as its context, so that queries find it."""
        nodes, edges = ingest.custom_graph(chunks, entities, relations)
        nodes, edges = materialise(nodes, "custom-nodes"), materialise(edges, "custom-edges")
        name = F.concat(F.lit("<hyperedge>"), F.concat_ws(" ", "keywords", "src", "tgt", "description")).alias("hyperedge")
        edges = edges.select(name, "src", "tgt", F.col("weight").cast("double").alias("weight"), "source_id")
        about = nodes.groupBy("name").agg(F.first("entity_type").alias("entity_type"), F.first("description").alias("description"))
        ends = edges.select("hyperedge", F.explode(F.array("src", "tgt")).alias("name"), "weight", "source_id")
        pos = F.struct(F.col("source_id").alias("chunk_id"), F.lit(0).alias("pos")).alias("pos")
        rows = ends.join(about, "name").select("hyperedge", F.col("name").alias("entity"), "entity_type", "description", F.lit("CONTEXT").alias("role"), "weight", pos)
        # what is known of an entity is embedded with its name, before the name alone would be
        self._embed("vec_entities", "ent-", nodes.select("name", F.concat("name", "description").alias("content")))
        self._add(edges.select("hyperedge", "weight", "source_id"), materialise(rows, "custom-rows"))
        self.store.upsert("entities", about.select(F.col("name").alias("entity"), "entity_type", "description"), "entity")
        text = chunks.select(content_id("chunk-", F.col("content")).alias("chunk_id"), F.col("source_id").alias("full_doc_id"), F.trim("content").alias("content"), F.lit(0).alias("chunk_order_index"), F.size(F.split(F.trim("content"), " ")).alias("tokens"))
        self.store.upsert("text_chunks", text, "chunk_id")

    def delete_document(self, paper: str) -> DataFrame:
        """Removes a paper's hyperedges, entities that only they had, and all their vectors; gives the status of each entity."""
        gone = materialise(self.store.read("belongs").filter(F.col("paper") == paper).select("hyperedge").distinct(), "gone")
        status = materialise(graph.cascade_delete(self.store.read("incidence"), gone), "status")
        lost = status.filter("status = 'orphaned'").select("entity")
        for name, column, names in (("hyperedges", "hyperedge", gone), ("incidence", "hyperedge", gone), ("belongs", "hyperedge", gone), ("entities", "entity", lost), ("vec_hyperedges", "name", gone), ("vec_entities", "name", lost)):
            self.store.delete(name, self.store.read(name).join(names.withColumnRenamed(names.columns[0], column), column, "left_semi"))
        return status

    def delete_entity(self, entity: str) -> None:
        for name, key in (("entities", "entity"), ("incidence", "entity"), ("vec_entities", "name")):
            self.store.delete(name, self.store.read(name).filter(F.upper(key) == entity.upper()))

    def delete_hyperedge(self, hyperedge: str) -> None:
        """A hyperedge by its name, with or without its mark, or by the id that its name hashes to."""
        row = self.store.read("vec_hyperedges").filter(F.col("name").isin(hyperedge, f"<hyperedge>{hyperedge}") | (F.col("id") == hyperedge)).select(F.col("name").alias("hyperedge"))
        gone = materialise(row, "gone")
        for name, column in (("hyperedges", "hyperedge"), ("incidence", "hyperedge"), ("belongs", "hyperedge"), ("vec_hyperedges", "name")):
            if self.store.exists(name):
                self.store.delete(name, self.store.read(name).join(gone.withColumnRenamed("hyperedge", column), column, "left_semi"))
