"""Evidence between retrieval and answer: filters, sources, tiers, and the two streams of a query put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import strip
from quillgraph.operators import fusion, graph
from quillgraph.session import materialise

# Edge labels that are no knowledge, the mark of a path's text, bodies whose guideline a title names, and the lines of a path's text.
LABELS = ["RELATES_TO", "BELONG_TO", "EVIDENCE"]
MARK = "【权威循证溯源："
BODIES = ["NCCN", "FIGO", "ESGO"]
HEAD_LINE = "【权威循证溯源：%s】(逻辑层级: Tier %d, 推荐度: %.4f)\n"
PATH_LINES = "  > 候选路径 %d [%s] (神经推演推荐度: %.2f%%)\n    ├─ 方案内容: %s\n    └─ 触发该方案的局部特征: 【%s】\n"


def knowledge_only(rows: DataFrame, text: str = "content") -> DataFrame:
    """Rows of five characters or more that are not labels of the store."""
    t = strip(F.col(text))
    return rows.filter((F.length(t) >= 5) & ~t.isin(LABELS))


def above(rows: DataFrame, score: str = "score", least: float = 0.01) -> DataFrame:
    """The reranker's cut: scores over ``least``."""
    return rows.filter(F.col(score) > least)


def lexical_tag(c: Column) -> Column:
    """graph for texts of paths, vector for others."""
    return F.when(c.startswith(MARK), "graph").otherwise("vector")


def source_fields(name: Column, pmid: Column, title: Column, guidelines: Column) -> list[Column]:
    """source_id without quotes; pmid if it is short, else what follows ``paper::`` in the name, else Unknown; title; guidelines as a list in a string."""
    clean = F.replace(F.coalesce(name, F.lit("Unknown")), F.lit('"'))
    number = F.when((F.length(pmid) > 0) & (F.length(pmid) < 20), pmid).when(clean.contains("paper::"), F.replace(clean, F.lit("paper::"))).otherwise("Unknown")
    heading = F.when(F.length(title) > 0, title).otherwise("No Title")
    return [clean.alias("source_id"), number.alias("pmid"), heading.alias("title"), F.coalesce(F.array_join(guidelines, ", "), F.lit("General Evidence")).alias("guidelines")]


def sources(evidence: DataFrame, papers: DataFrame, belongs: DataFrame) -> DataFrame:
    """(id, source_id, pmid, title, guidelines) of evidence(id, content): the paper a path's text names, by name or pmid; else the papers of its hyperedge.

    Each branch is an equi-join; papers(name, pmid, title, guidelines), belongs(paper, hyperedge).
    """
    asked = strip(F.regexp_extract("content", "【权威循证溯源：(.*?)】", 1))
    macro = evidence.filter(F.col("content").startswith(MARK)).select("id", asked.alias("_k")).filter("_k <> ''")
    named = macro.join(papers, F.col("_k") == F.col("name"))
    coded = macro.join(papers, (F.col("_k") == F.col("pmid")) & ~F.coalesce(F.col("pmid") == F.col("name"), F.lit(False)))
    micro = evidence.filter(~F.col("content").startswith(MARK)).select("id", F.concat(F.lit("<hyperedge>"), "content").alias("hyperedge"))
    owned = micro.join(belongs, "hyperedge").join(papers, F.col("paper") == F.col("name"))
    out = ["id", *source_fields(F.col("name"), F.col("pmid"), F.col("title"), F.col("guidelines"))]
    return named.select(*out).unionByName(coded.select(*out)).unionByName(owned.select(*out))


def best_tiers(evidence: DataFrame, found: DataFrame) -> DataFrame:
    """evidence with ``tier``: the best tier of its sources (id, guidelines), 4 without any."""
    tiers = found.groupBy("id").agg(F.min(fusion.guideline_tier(F.col("guidelines"))).alias("_t"))
    return evidence.join(tiers, "id", "left").withColumn("tier", F.least(F.coalesce("_t", F.lit(4)), F.lit(4))).drop("_t")


def guideline_papers(papers: DataFrame, bodies: list[str]) -> DataFrame:
    """(body, name): the guideline itself; of papers with the body among their guidelines those that name one in the title, then the shortest title."""
    own = F.exists(F.array(*map(F.lit, BODIES)), lambda b: F.col("title").contains(b))
    each = papers.withColumn("body", F.explode(F.array(*map(F.lit, bodies)))).filter(F.exists("guidelines", lambda g: F.contains(F.lower(g), F.lower("body"))))
    return each.groupBy("body").agg(F.min_by("name", F.struct((~own).cast("int"), F.length("title"), "name")).alias("name"))


def coverage_summary(rows: DataFrame, group: str, status: str = "status") -> DataFrame:
    """(group, total, covered, partial, uncovered)."""
    count = lambda s: F.count_if(F.col(status) == s).alias(s)
    return rows.groupBy(group).agg(F.count("*").alias("total"), count("covered"), count("partial"), count("uncovered"))


def vector_stream(hits: DataFrame, nodes: DataFrame, k: int = 60, rerank=None) -> DataFrame:
    """(query_id, item, weight, rank from 0) of hits(query_id, hyperedge) that are stored, in order of weight, marks stripped.

    rerank, a column function (text of the question, item), gives the weight
    instead; hits then have ``text``, and only scores over the reranker's cut
    stay. nodes(hyperedge, weight).
    """
    line = Window.partitionBy("query_id").orderBy(F.col("weight").desc(), "hyperedge")
    found = hits.join(nodes.select("hyperedge", "weight"), "hyperedge")
    if rerank is not None:
        found = above(found.withColumn("weight", rerank(F.col("text"), F.regexp_replace("hyperedge", "^<hyperedge>", ""))), "weight")
    ranked = found.withColumn("rank", F.row_number().over(line) - 1).filter(F.col("rank") < k)
    return ranked.select("query_id", F.regexp_replace("hyperedge", "^<hyperedge>", "").alias("item"), "weight", "rank")


def paper_neighbours(belongs: DataFrame, cap: int = 50) -> DataFrame:
    """belongs(paper, hyperedge) with at most ``cap`` papers a hyperedge, by name."""
    line = Window.partitionBy("hyperedge").orderBy("paper")
    return belongs.select("paper", "hyperedge").distinct().withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= cap).drop("_r")


#: Entities asked for up to which they are sent to where the incidence is read.
FEW_ENTITIES = 1 << 20


def graph_stream(hits: DataFrame, incidence: DataFrame, belongs: DataFrame, scores: DataFrame, similarities: DataFrame | None = None, cap: int = 50, parents: int = 5, paths: int = 4) -> DataFrame:
    """(query_id, paper, tier, coverage, n_hyperedges, rank, text): papers that the entities found for a query lead to, with their best paths as text.

    hits(query_id, entity); entities that are not stored drop out. Entities keep
    ``cap`` hyperedges (all recommendations first), hyperedges as many papers.
    A paper's coverage is the sum of the positive scores(hyperedge, score) that
    the query reaches; tier (3 with a recommendation, 2 with evidence) and count
    are those of all that it reaches, whatever their score. Scores, one a
    hyperedge, may be those of each query, scores(query_id, hyperedge, score).
    """
    wanted = materialise(hits.select("query_id", "entity").distinct(), "wanted")
    entities = wanted.select("entity").distinct()
    # scores and papers join where a hyperedge's entities stand together, so what queries reach moves once, in narrow rows
    papers = paper_neighbours(belongs, cap).groupBy("hyperedge").agg(F.collect_list("paper").alias("_papers"))
    own = "query_id" in scores.columns
    near = incidence.select("hyperedge", "entity", "role").join(papers if own else papers.join(scores.select("hyperedge", "score"), "hyperedge", "left"), "hyperedge", "left")
    if entities.count() <= FEW_ENTITIES:
        near = near.join(F.broadcast(entities), "entity", "left_semi")
    near = materialise(near, "near")
    kept = graph.capped_neighbours(near, similarities, cap).drop("sim").filter("_papers IS NOT NULL")
    linked = wanted.join(kept, "entity")
    if own:
        linked = linked.join(scores, ["query_id", "hyperedge"], "left")
    value = F.first("score").alias("score")
    reached = linked.repartition("query_id").groupBy("query_id", "hyperedge").agg(F.array_sort(F.collect_set("entity")).alias("entities"), F.array_sort(F.collect_set("role")).alias("roles"), *graph.tier_flags(), value, F.first("_papers").alias("_papers"))
    line = Window.partitionBy("query_id", "paper").orderBy(F.col("score").desc(), "hyperedge")
    rows = reached.withColumn("paper", F.explode("_papers")).drop("_papers").withColumn("_r", F.row_number().over(line))
    entry = F.format_string(PATH_LINES, "_r", F.array_join("roles", "/"), F.col("score") * 100, F.col("hyperedge").cast("string"), F.array_join(F.transform("entities", lambda e: e.cast("string")), ", "))
    best = F.collect_list(F.when((F.col("_r") <= paths) & (F.col("score") > 0), F.struct("_r", entry.alias("t")))).alias("_best")
    covered = rows.groupBy("query_id", "paper").agg(*graph.covered(F.col("score")), best).filter("coverage IS NOT NULL")
    order = Window.partitionBy("query_id").orderBy(F.col("tier").desc(), F.col("coverage").desc(), F.col("n_hyperedges").desc(), "paper")
    top = covered.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= parents)
    head = F.format_string(HEAD_LINE, F.col("paper").cast("string"), "tier", "coverage")
    text = F.array_join(F.transform(F.array_sort("_best"), lambda x: x["t"]), "")
    return top.select("query_id", "paper", "tier", "coverage", "n_hyperedges", "rank", F.concat(head, text).alias("text"))


def bm25_and_vector(documents: DataFrame, asked: DataFrame, vector: DataFrame, k: int = 60, coherence: float = 0.8) -> DataFrame:
    """(query_id, item, coherence, rank) without the graph: BM25 over documents(item, tokens) and the vector list fused by reciprocal ranks, at one coherence."""
    lexical = fusion.bm25(documents.withColumnRenamed("item", "doc_id"), asked).filter("score > 0")
    line = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    lexical = lexical.withColumn("rank", F.row_number().over(line) - 1).filter(F.col("rank") < k).select("query_id", F.col("doc_id").alias("item"), "rank")
    fused = fusion.reciprocal_ranks(lexical.unionByName(vector.select("query_id", "item", "rank")))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "item", F.lit(coherence).alias("coherence"), "rank")


def related_entities(found: DataFrame, incidence: DataFrame, nodes: DataFrame, budget: int) -> DataFrame:
    """(query_id, pos, entity, degree, tokens): entities of found(query_id, pos, hyperedge), each at its first place, with degrees, as far as descriptions fit the budget."""
    rows = found.join(incidence.select("hyperedge", "entity"), "hyperedge").groupBy("query_id", "entity").agg(F.min("pos").alias("_p"))
    ordered = rows.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "entity"))).drop("_p")
    degree = incidence.groupBy("entity").agg(F.count("*").alias("degree"))
    full = ordered.join(nodes.select("entity", F.size(F.split("description", " ")).alias("tokens")), "entity").join(degree, "entity")
    return fusion.token_budget(full, budget).select("query_id", "pos", "entity", "degree", "tokens")


def related_chunks(relations: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """(query_id, pos, chunk_id, tokens): chunks that relations(query_id, pos, source_ids) name, by first mention, as far as they fit the budget."""
    ids = relations.select("query_id", "pos", F.explode(F.split("source_ids", "<SEP>")).alias("chunk_id")).groupBy("query_id", "chunk_id").agg(F.min("pos").alias("_p"))
    ordered = ids.join(chunks.select("chunk_id", "tokens"), "chunk_id").withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_p", "chunk_id")))
    return fusion.token_budget(ordered, budget).select("query_id", "pos", "chunk_id", "tokens")


def stored_nodes(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """names(query_id, name, ...) with their node's columns; what is not stored drops out."""
    return names.join(nodes, "name")


def node_or_absent(names: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """names with their node's columns, ``present`` and ``degree`` over undirected edges(src, tgt); nulls and 0 where there is none."""
    marked = nodes.withColumn("present", F.lit(True))
    degree = graph.degrees(edges).withColumnRenamed("node", "name")
    return names.join(marked, "name", "left").join(degree, "name", "left").withColumns({"present": F.coalesce("present", F.lit(False)), "degree": F.coalesce("degree", F.lit(0))})


def edge_or_absent(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs(src, tgt) with ``weight`` of the edge between them in either direction, null where there is none."""
    both = graph.undirected(edges.select("src", "tgt", "weight")).groupBy("src", "tgt").agg(F.max("weight").alias("weight"))
    return pairs.join(both, ["src", "tgt"], "left")


def delete_edges(edges: DataFrame, gone: DataFrame, directed: bool = True) -> DataFrame:
    """edges without gone(src, tgt), in both directions if undirected."""
    both = gone.select("src", "tgt") if directed else graph.undirected(gone.select("src", "tgt"))
    return edges.join(both, ["src", "tgt"], "left_anti").select(*edges.columns)


def property_match(matches: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that a property match (kind, key) names: nodes by name, edges by id."""
    keys = matches.select("kind", "key").distinct()
    pick = lambda kind, name: keys.filter(F.col("kind") == kind).select(F.col("key").alias(name))
    return nodes.join(pick("node", "name"), "name"), edges.join(pick("edge", "id"), "id")


def newest_edges(edges: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """The n newest edges(id, created, chunk_id) with the text of their chunk, null where it is not stored."""
    last = edges.orderBy(F.col("created").desc(), "id").limit(n)
    return last.join(chunks, "chunk_id", "left")


def in_workspace(rows: DataFrame, workspace: str) -> DataFrame:
    """One tenant's rows; a table partitioned by ``workspace`` reads only its folder."""
    return rows.filter(F.col("workspace") == workspace)


def graph_or_default(score: Column, hard: Column) -> Column:
    """Score of a text that the graph missed: 0.05 for a hard negative, else 0.1."""
    return F.coalesce(score, F.when(hard, 0.05).otherwise(0.1))


def probability(logit: Column) -> Column:
    return F.round(1 / (1 + F.exp(-logit)), 4)


def contraindicated(anchors: DataFrame, incidence: DataFrame, per_term: int = 2, terms: int = 2) -> DataFrame:
    """(anchor_id, hyperedge): for the last terms of a complex anchor(anchor_id, terms, is_complex) hyperedges that forbid an entity of that name."""
    empty = ["无", "None", "未提及", ""]
    asked = anchors.filter("is_complex").select("anchor_id", F.explode(F.slice("terms", F.greatest(F.size("terms") - terms + 1, F.lit(1)), F.lit(terms))).alias("entity"))
    asked = asked.withColumn("entity", strip(F.col("entity"))).filter(~F.col("entity").isin(empty)).distinct()
    line = Window.partitionBy("entity").orderBy("hyperedge")
    few = incidence.filter("role = 'CONTRAINDICATION'").select("entity", "hyperedge").distinct().withColumn("_r", F.row_number().over(line)).filter(F.col("_r") <= per_term)
    return asked.join(few, "entity").select("anchor_id", "hyperedge").distinct()


def by_pmid(papers: DataFrame, pmids: DataFrame) -> DataFrame:
    """Papers of pmids(pmid)."""
    return papers.join(pmids.select("pmid").distinct(), "pmid", "left_semi")
