"""Hypergraph operators over typed bipartite tables: incidence(hyperedge, entity, role, weight) and belongs(paper, hyperedge)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import dealt, materialise


def undirected(edges: DataFrame) -> DataFrame:
    """edges(src, tgt, ...) in both directions."""
    turned = edges.select(*[F.col({"src": "tgt", "tgt": "src"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(turned)


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges.select("src", "tgt")).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Degree of an edge: those of its ends together."""
    d = degrees(edges)
    both = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("_s")), "src").join(d.select(F.col("node").alias("tgt"), F.col("degree").alias("_t")), "tgt")
    return both.withColumn("edge_degree", F.col("_s") + F.col("_t")).drop("_s", "_t")


def idf(incidence: DataFrame) -> DataFrame:
    """(entity, df, idf_weight): round(ln(N / (df + 1)) + 1, 4) with N hyperedges in all; incidence has one row a pair."""
    n = incidence.select("hyperedge").distinct().agg(F.count("*").alias("_n"))
    df = incidence.groupBy("entity").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("entity", "df", F.round(F.log(F.col("_n") / (F.col("df") + 1)) + 1.0, 4).alias("idf_weight"))


def capped_neighbours(incidence: DataFrame, scores: DataFrame | None, cap: int = 50) -> DataFrame:
    """Hyperedges kept for each entity: all recommendations, then the best others until ``cap``; scores(entity, hyperedge, sim), without them all are equal."""
    # others by row number up to a constant: Spark cuts a hot entity's rows in each task before it shuffles them
    strong = F.col("role").eqNullSafe(F.lit("RECOMMENDATION"))
    rows = incidence.withColumn("sim", F.lit(0.0))
    if scores is not None:
        rows = incidence.join(scores, ["entity", "hyperedge"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    line = Window.partitionBy("entity").orderBy(F.col("sim").desc(), F.col("hyperedge").desc())
    first = rows.filter(~strong).withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= cap)
    taken = incidence.filter(strong).groupBy("entity").agg(F.count("*").alias("_n"))
    others = first.join(taken, "entity", "left").filter(F.col("_r") <= cap - F.coalesce("_n", F.lit(0)))
    return rows.filter(strong).unionByName(others.select(*rows.columns))


def padded_tensor(incidence: DataFrame, vectors: DataFrame, cap: int = 40) -> DataFrame:
    """(hyperedge, members): up to ``cap`` entities with a vector, by name; names match in upper case and misses drop out."""
    named = incidence.join(vectors.select(F.upper("name").alias("_n"), "vector"), F.upper("entity") == F.col("_n"))
    line = Window.partitionBy("hyperedge").orderBy("entity")
    first = named.withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= cap)
    return first.groupBy("hyperedge").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "entity", "role", "vector"))), lambda x: F.struct(x["entity"], x["role"], x["vector"])).alias("members"))


def parent_coverage(belongs: DataFrame, scores: DataFrame, roles: DataFrame) -> DataFrame:
    """(paper, coverage, tier, n_hyperedges) of papers with a positive score.

    Only positive scores add up; tier (3 with a recommendation, 2 with evidence,
    else 1) and count are those of all its hyperedges, scored or not.
    """
    rows = belongs.join(scores, "hyperedge", "left").join(roles.groupBy("hyperedge").agg(*tier_flags()), "hyperedge", "left")
    return rows.groupBy("paper").agg(*covered(F.col("score"))).filter("coverage IS NOT NULL")


def tier_flags(role: str = "role") -> list[Column]:
    """Whether a group of incidences has a recommendation, and evidence."""
    return [F.max((F.col(role) == r).cast("int")).alias(c) for r, c in (("RECOMMENDATION", "_rec"), ("EVIDENCE", "_ev"))]


def covered(score: Column) -> list[Column]:
    """coverage (null without a positive score), tier and n_hyperedges of a paper's rows with their tier flags."""
    tier = F.when(F.max("_rec") == 1, 3).when(F.max("_ev") == 1, 2).otherwise(1)
    return [F.round(F.sum(F.when(score > 0, score)), 4).alias("coverage"), tier.alias("tier"), F.count("*").alias("n_hyperedges")]


def top_parents(covered: DataFrame, k: int = 5) -> DataFrame:
    return covered.orderBy(F.col("tier").desc(), F.col("coverage").desc(), F.col("n_hyperedges").desc(), "paper").limit(k)


def best_of_parent(belongs: DataFrame, scores: DataFrame, k: int = 4) -> DataFrame:
    line = Window.partitionBy("paper").orderBy(F.col("score").desc(), "hyperedge")
    return belongs.join(scores, "hyperedge").withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)


def cascade_delete(incidence: DataFrame, doc_hyperedges: DataFrame) -> DataFrame:
    """(entity, status) of entities that lose a hyperedge: orphaned if all of theirs go, else shared."""
    gone = doc_hyperedges.select("hyperedge", F.lit(True).alias("_gone")).distinct()
    marked = incidence.join(gone, "hyperedge", "left").groupBy("entity").agg(F.min(F.coalesce("_gone", F.lit(False)).cast("int")).alias("_all"), F.max(F.coalesce("_gone", F.lit(False)).cast("int")).alias("_any"))
    return marked.filter("_any = 1").select("entity", F.when(F.col("_all") == 1, "orphaned").otherwise("shared").alias("status"))


def second_hop(incidence: DataFrame, starts: DataFrame, factor: float = 0.8, k: int = 3, roles: tuple[str, ...] = ("RECOMMENDATION", "CONTRAINDICATION")) -> DataFrame:
    """Other hyperedges that share an entity with starts(hyperedge, score) in one of roles; k a start, scores damped."""
    incidence = materialise(incidence.select("hyperedge", "entity", "role"), "incidence")
    left = dealt(starts.join(incidence.select("hyperedge", "entity"), "hyperedge"), "entity", n=incidence.count() * (k + 1))
    # of an entity's targets the first k and one, which may be the start itself, are all that can count
    first = Window.partitionBy("entity").orderBy("hyperedge")
    right = incidence.filter(F.col("role").isin(*roles)).select("hyperedge", "entity").distinct()
    right = right.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1).select(F.col("hyperedge").alias("target"), "entity")
    pairs = left.join(right, "entity").filter("hyperedge <> target").select("hyperedge", "score", "target")
    # a pair that is there twice has one rank: each task keeps the first k of a start before pairs move
    line = Window.partitionBy("hyperedge").orderBy("target", "score")
    return pairs.withColumn("_r", F.dense_rank().over(line)).filter(F.col("_r") <= k).distinct().select("hyperedge", "target", (F.col("score") * factor).alias("score"))


def subgraph_features(incidence: DataFrame, weights: DataFrame) -> DataFrame:
    """(hyperedge, members): entity, role (default CONTEXT) and weight (default 1) of each."""
    rows = incidence.join(weights.select("entity", "idf_weight"), "entity", "left")
    item = F.struct("entity", F.coalesce("role", F.lit("CONTEXT")).alias("role"), F.coalesce("idf_weight", F.lit(1.0)).alias("idf_weight"))
    return rows.groupBy("hyperedge").agg(F.array_sort(F.collect_list(item)).alias("members"))


def stable_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, source not after target, ordered."""
    return edges.select(F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")).distinct().orderBy("src", "tgt")


#: Edges of a graph that one task goes through; larger ones are labelled in rounds.
ONE_TASK = 200_000


def _connected(edges: pd.DataFrame) -> pd.DataFrame:
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in zip(edges["src"], edges["tgt"], strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = list(root)
    return pd.DataFrame({"node": nodes, "c": [find(x) for x in nodes]})


def component_labels(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, c) for the nodes of edges(src, tgt): c is the smallest node that can be reached.

    Up to ``most`` edges go to one task. Larger graphs shrink in rounds: each
    node goes to the least neighbour of its least neighbour, edges are those
    between what is left, and a node that others went to stays linked to where
    it went. So only the first round sees all edges.
    """
    edges = materialise(edges.select("src", "tgt").filter("src <> tgt").distinct(), "component-edges")
    kind, rounds = dict(edges.dtypes)["src"], []
    while (left := edges.count()) > (ONE_TASK if most is None else most):
        near = undirected(edges).groupBy(F.col("src").alias("node")).agg(F.min("tgt").alias("up"))
        near = materialise(near.select("node", F.least("node", "up").alias("up")), "component-near")
        label = materialise(near.join(near.select(F.col("node").alias("up"), F.col("up").alias("c")), "up").select("node", "c"), "components")
        rounds.append(label)
        ends = label.select(F.col("node").alias("src"), F.col("c").alias("a")), label.select(F.col("node").alias("tgt"), F.col("c").alias("b"))
        moved = edges.join(ends[0], "src").join(ends[1], "tgt").select("a", "b").filter("a <> b")
        links = label.filter("node <> c").join(label.select(F.col("c").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("a"), F.col("c").alias("b"))
        edges = materialise(moved.unionByName(links).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("tgt")).distinct(), "component-edges")
    out = materialise(edges.groupBy().applyInPandas(_connected, f"node {kind}, c {kind}"), "components") if left or not rounds else rounds.pop()
    for label in reversed(rounds):  # from the small end, so that what all lead to meets few rows
        out = materialise(label.join(out.select(F.col("node").alias("c"), F.col("c").alias("_c")), "c", "left").select("node", F.coalesce("_c", "c").alias("c")), "components")
    return out


def largest_component(edges: DataFrame) -> DataFrame:
    """Nodes of the largest component (ties: the one with the smallest node)."""
    label = component_labels(edges)
    top = label.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "c").limit(1)
    return label.join(F.broadcast(top), "c").select("node", F.col("c").alias("component"))


def soft_neighbours(lonely: DataFrame, vectors: DataFrame, k: int = 3, least: float = 0.85) -> DataFrame:
    """For nodes without edges: the k most similar other nodes as CONTEXT edges."""
    from quillgraph.operators.vector import top_k

    found = top_k(lonely.select(F.col("node").alias("query_id"), "vector"), vectors.select(F.col("node").alias("id"), "vector"), k, least, True)
    return found.select(F.col("query_id").alias("src"), F.col("id").alias("tgt"), F.lit("CONTEXT").alias("role"), F.col("similarity").alias("weight"))


def first_source(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that relations(pos, source_ids) name, each at the position of the first that does."""
    ids = relations.select("pos", F.explode(F.split("source_ids", "<SEP>")).alias("chunk_id")).groupBy("chunk_id").agg(F.min("pos").alias("pos"))
    return ids.join(chunks, "chunk_id")


def any_of(column: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: column.contains(p))
