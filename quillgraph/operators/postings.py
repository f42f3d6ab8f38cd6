"""A stored inverted index for BM25: who asks reads the buckets of the terms asked for, not the texts."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import fusion
from quillgraph.session import bound_batches, materialise
from quillgraph.sources.tables import DeltaStore


class Postings:
    """Postings (term, doc_id, tf), partitioned by batch and a hash bucket of the term, and two small tables.

    ``lengths`` holds documents with their length and batch; a posting counts if
    its document stands there with the posting's batch, so a batch counts from
    the moment its lengths are stored, and a document that is removed or added
    anew leaves nothing behind. ``terms`` holds in how many documents a term is,
    as changes by batch. A document without tokens has a length of 0.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.buckets = spark, f"{root.rstrip('/')}/postings", buckets
        self.store = DeltaStore(spark, root)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame) -> None:
        """docs(doc_id, tokens), each id once; those that are there already are replaced."""
        docs = docs.select("doc_id", "tokens")
        self.remove(docs.select("doc_id"))
        bound_batches(self.spark)
        batch, kind = uuid.uuid4().hex, dict(docs.dtypes)["doc_id"]

        def counted(batches):  # a document's terms are counted where it is read, so only postings are shuffled
            for batch in batches:
                for i in range(0, batch.num_rows, 256):
                    part = batch.slice(i, 256)
                    codes = part.column(1).flatten().dictionary_encode(null_encoding="encode")
                    size = max(len(codes.dictionary), 1)
                    of = pc.list_parent_indices(part.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
                    both, n = np.unique(of * size + codes.indices.to_numpy(zero_copy_only=False), return_counts=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(both // size)), codes.dictionary.take(pa.array(both % size)), pa.array(n, pa.int64())], names=["doc_id", "term", "tf"])

        rows = docs.mapInArrow(counted, f"doc_id {kind}, term string, tf long").withColumn("bucket", self._bucket())
        # rows of a bucket go to few files, a hot term's to several
        rows.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("bucket").parquet(f"{self.root}/batch={batch}")
        new = self._postings(kind).filter(F.col("batch") == batch)
        self.store.upsert("terms", new.groupBy("term").agg(F.count("*").alias("df")).withColumn("batch", F.lit(batch)), ["term", "batch"])
        self.store.upsert("lengths", docs.select("doc_id", F.greatest(F.size("tokens"), F.lit(0)).alias("len"), F.lit(batch).alias("batch")), "doc_id", "rows")

    def remove(self, ids: DataFrame) -> None:
        """Documents with these ids(doc_id) go."""
        if not self.store.exists("lengths"):
            return
        gone = materialise(self.store.read("lengths").join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), "removed")
        if gone.isEmpty():
            return
        lost = self._postings(dict(gone.dtypes)["doc_id"]).join(gone, ["doc_id", "batch"], "left_semi").groupBy("term").agg((-F.count("*")).alias("df"))
        self.store.upsert("terms", lost.withColumn("batch", F.lit(f"minus-{uuid.uuid4().hex}")), ["term", "batch"])
        self.store.delete("lengths", gone.select("doc_id"))

    def _postings(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"doc_id {kind}, term string, tf long, batch string, bucket int").parquet(self.root)

    def scores(self, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """(query_id, doc_id, score) for queries(query_id, tokens): what fusion.bm25 gives for the stored documents."""
        asked = materialise(queries.select("query_id", F.explode("tokens").alias("term")).withColumn("bucket", self._bucket()), "asked")
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # as many as there are at most
        lengths, terms = self.store.read("lengths"), self.store.read("terms").groupBy("term").agg(F.sum("df").alias("_df")).filter("_df > 0")
        stats = lengths.agg(F.count("*").alias("_n"), F.avg("len").alias("_avg"))
        weight = fusion.term_weights(terms, stats, epsilon).join(asked.select("term").distinct(), "term", "left_semi")
        wanted = self._postings(dict(lengths.dtypes)["doc_id"]).filter(F.col("bucket").isin(buckets)).join(asked.select("term").distinct(), "term", "left_semi")
        tf = wanted.join(lengths, ["doc_id", "batch"]).select("doc_id", F.col("len").alias("_len"), "term", F.col("tf").alias("_tf"))
        return fusion.term_scores(asked.select("query_id", "term"), weight, tf, k1, b)
