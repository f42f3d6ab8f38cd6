"""Lexical scores, rank fusion, cut-offs and ordering of evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(query_id, doc_id, score) of docs(doc_id, tokens) for queries(query_id, tokens); negative idf becomes epsilon times the mean idf.

    Document frequencies are counted from each document's distinct terms;
    term frequencies only for terms of the queries, which are joined first.
    """
    sized = docs.withColumn("_len", F.size("tokens"))
    stats = sized.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    df = sized.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("_df"))
    asked = queries.select("query_id", F.explode("tokens").alias("term"))
    wanted = asked.select("term").distinct()
    tf = sized.select("doc_id", "_len", F.explode("tokens").alias("term")).join(wanted, "term", "left_semi").groupBy("doc_id", "_len", "term").agg(F.count("*").alias("_tf"))
    return term_scores(asked, term_weights(df, stats, epsilon), tf, k1, b)


def term_weights(df: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, _idf, _avg) of document frequencies df(term, _df) and one row of stats(_n documents, _avg length)."""
    raw = df.crossJoin(F.broadcast(stats)).withColumn("_idf", F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5))
    mean = raw.agg(F.avg("_idf").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "_avg", F.when(F.col("_idf") < 0, epsilon * F.col("_mean")).otherwise(F.col("_idf")).alias("_idf"))


def term_scores(asked: DataFrame, weight: DataFrame, tf: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score) of asked(query_id, term), term weights and tf(doc_id, _len, term, _tf)."""
    hits = asked.join(weight, "term").join(tf, "term")
    part = F.col("_idf") * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def reciprocal_ranks(lists: DataFrame, constant: int = 60) -> DataFrame:
    """(query_id, item, score): sum of 1 / (constant + rank + 1), ranks from 0."""
    return lists.groupBy("query_id", "item").agg(F.sum(1.0 / (constant + F.col("rank") + 1)).alias("score"))


def weighted_fusion(vector: DataFrame, graph: DataFrame, gate: float | Column = 0.5, top: int = 60, constant: int = 60, bonus: float = 1.2) -> DataFrame:
    """(query_id, item, coherence, rank) of two ranked lists (query_id, item, rank from 0).

    The vector list weighs 1 - gate and the graph list gate; what both have
    gets the bonus. An item counts once a list, at its best rank.
    """
    gate = F.lit(gate) if not isinstance(gate, Column) else gate
    once = lambda df, w, s: df.groupBy("query_id", "item").agg(F.min("rank").alias("rank")).select("query_id", "item", (w / (constant + F.col("rank") + 1)).alias("part"), F.lit(s).alias("stream"))
    both = once(vector, 1 - gate, "vector").unionByName(once(graph, gate, "graph"))
    fused = both.groupBy("query_id", "item").agg(F.sum("part").alias("_s"), F.count("*").alias("_n"))
    fused = fused.withColumn("coherence", F.round(F.when(F.col("_n") == 2, F.col("_s") * bonus).otherwise(F.col("_s")), 4))
    line = Window.partitionBy("query_id").orderBy(F.col("coherence").desc(), F.col("_s").desc(), "item")
    return fused.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= top).select("query_id", "item", "coherence", "rank")


def second_channel(first: DataFrame, second: DataFrame, factor: float = 0.85) -> DataFrame:
    """First channel, and what only the second has, damped."""
    extra = second.join(first, ["query_id", "item"], "left_anti").select("query_id", "item", F.round(F.col("score") * factor, 6).alias("score"), F.lit("second").alias("channel"))
    return first.select("query_id", "item", F.round("score", 6).alias("score"), F.lit("first").alias("channel")).unionByName(extra)


def adaptive_cut(ranked: DataFrame, least: int = 5, most: int = 20, drop: float = 0.5) -> DataFrame:
    """Rows (query_id, score, i from 0) before the first relative drop over ``drop`` at or after ``least``, ``most`` at most."""
    line = Window.partitionBy("query_id").orderBy("i")
    rows = ranked.withColumn("_prev", F.lag("score").over(line)).withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    cap = F.least("_n", F.lit(most))
    broken = (F.col("_prev") > 1e-8) & ((F.col("_prev") - F.col("score")) / F.col("_prev") > drop) & (F.col("i") >= least) & (F.col("i") < cap)
    rows = rows.withColumn("_k", F.least("_n", F.coalesce(F.min(F.when(broken, F.col("i"))).over(Window.partitionBy("query_id")), F.greatest(F.lit(least), cap))))
    return rows.filter(F.col("i") < F.col("_k")).drop("_prev", "_n", "_k")


def token_budget(rows: DataFrame, budget: int, tokens: str = "tokens", key: str = "query_id", order: str = "pos") -> DataFrame:
    """The prefix of each list whose tokens fit the budget."""
    line = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(tokens).over(line)).filter(F.col("_sum") <= budget).drop("_sum")


def first_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Ordered dedupe."""
    line = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(line)).filter("_r = 1").drop("_r")


# Guideline bodies in order of authority.
AUTHORITIES = ["ESGO", "FIGO", "NCCN"]


def guideline_tier(c: Column) -> Column:
    up, out = F.upper(F.coalesce(c, F.lit(""))), F.lit(4)
    for tier, name in reversed(list(enumerate(AUTHORITIES, 1))):
        out = F.when(up.contains(name), tier).otherwise(out)
    return out


def final_score(graph: Column, semantic: Column, tier: Column, gate: float = 0.5) -> Column:
    return gate * graph + (1 - gate) * semantic + (4 - tier) * 0.1


def yes_probability(yes: Column, no: Column) -> Column:
    """p(yes) / (p(yes) + p(no)) of log-probabilities, -10 where missing."""
    return 1 / (1 + F.exp(F.coalesce(no, F.lit(-10.0)) - F.coalesce(yes, F.lit(-10.0))))


def bibliography(rows: DataFrame, pinned: str) -> DataFrame:
    """(source, number): sources by first appearance (source, pos); the pinned one is 1."""
    first = rows.groupBy("source").agg(F.min("pos").alias("pos")).filter(F.col("source") != pinned)
    line = Window.orderBy("pos", "source")
    spark = rows.sparkSession
    head = spark.createDataFrame([(pinned, 1)], "source string, number int")
    return head.unionByName(first.select("source", (F.row_number().over(line) + 1).alias("number")))


def graph_score(rows: DataFrame, least: float = 0.4) -> DataFrame:
    """(text_id, score) of rows(text_id, rank, contained, coherence, sim): the first containment decides, else the best damped coherence."""
    best = rows.groupBy("text_id").agg(
        F.min_by("coherence", F.when(F.col("contained"), F.col("rank"))).alias("_c"),
        F.max(F.col("contained").cast("int")).alias("_has"),
        F.max(F.when(F.col("sim") > least, F.col("coherence") * F.sqrt("sim"))).alias("_s"),
    )
    return best.select("text_id", F.round(F.when(F.col("_has") == 1, F.greatest(F.lit(0.01), F.col("_c"))).otherwise(F.coalesce("_s", F.lit(0.0))), 4).alias("score"))


def stratified_order(rows: DataFrame, top: int = 15) -> DataFrame:
    """By relevance level (0.03, 0.015), tier, score."""
    level = F.when(F.col("score") >= 0.03, 1).when(F.col("score") >= 0.015, 2).otherwise(3)
    return rows.withColumn("level", level).orderBy("level", "tier", F.col("score").desc(), "item").limit(top)
