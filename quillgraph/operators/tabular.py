"""Tabular features, similar-record search, folds and quality statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import vector


def median_imputed(df: DataFrame, numeric: list[str], categorical: list[str], binary: list[str]) -> DataFrame:
    """Numbers to the exact median, categories to unknown, flags to 0."""
    medians = df.agg(*[F.percentile(c, 0.5).alias(f"_m_{c}") for c in numeric])
    out = df.crossJoin(F.broadcast(medians)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in numeric})
    out = out.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in categorical} | {c: F.coalesce(c, F.lit(0)) for c in binary})
    return out.drop(*[f"_m_{c}" for c in numeric])


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores with the population deviation, 0 where it is 0."""
    stats = df.agg(*[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    z = lambda c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_a_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    return df.crossJoin(F.broadcast(stats)).withColumns({c: z(c) for c in columns}).drop(*[f"_{k}_{c}" for c in columns for k in "as"])


def one_hot(column: str, values: list[str], drop_first: bool = False) -> list[Column]:
    """Indicators in sorted order; unseen values are all zero."""
    return [(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in sorted(values)[drop_first:]]


def soft_assignment(features: Column, centres: list[list[float]]) -> list[Column]:
    """softmax of the negative distances to fixed centres."""
    dist = [F.sqrt(F.aggregate(F.zip_with(features, F.array(*map(F.lit, c)), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)) for c in centres]
    least = F.least(*dist) if len(dist) > 1 else dist[0]
    exps = [F.exp(least - d) for d in dist]
    return [e / sum(exps[1:], exps[0]) for e in exps]


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "manhattan", exclude_self: bool = False, units: tuple[float, ...] | None = None) -> DataFrame:
    """(query_id, id, distance, rank) of queries(query_id, features) in corpus(id, features): exact, see operators.vector.nearest.

    units divide the differences of the features; ties are those of their exact differences.
    """
    found = vector.nearest(queries.withColumnRenamed("features", "vector"), corpus.withColumnRenamed("features", "vector"), k, metric, exclude_self=exclude_self, units=units)
    return found.withColumnRenamed("cost", "distance")


def folds(df: DataFrame, label: str, key: str, n: int = 5) -> DataFrame:
    """Stratified fold of each row: a hash order within each label, dealt in turn.

    The order is cut by its first digits, so a label's rows are ranked in many
    tasks; what stands before each cut comes from counts of the cuts.
    """
    rows = df.withColumn("_m", F.md5(F.col(key).cast("string"))).withColumn("_cut", F.left("_m", F.lit(3)))
    before = Window.partitionBy(label).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = rows.groupBy(label, "_cut").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cuts = cuts.select(F.col(label).alias("_label"), F.col("_cut").alias("_c"), "_before")
    line = Window.partitionBy(label, "_cut").orderBy("_m", key)
    ranked = rows.withColumn("_r", F.row_number().over(line)).join(cuts, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_cut") == F.col("_c")))
    return ranked.withColumn("fold", ((F.col("_before") + F.col("_r") - 1) % n).cast("int")).select(*df.columns, "fold")


def fit_labels(df: DataFrame, features: list[str], labels: list[str], kind: str = "gbt", **params):
    """One fitted pipeline a label, rows weighted by neg / (pos + 1e-5) for positives."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    out = {}
    for label in labels:
        pos = df.agg(F.avg(label).alias("p")).first()["p"] or 0.0
        weighted = df.withColumn("_w", F.when(F.col(label) == 1, (1 - pos) / (pos + 1e-5)).otherwise(1.0))
        model = (GBTClassifier if kind == "gbt" else RandomForestClassifier)(labelCol=label, featuresCol="_f", weightCol="_w", seed=42, **params)
        out[label] = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="keep"), model]).fit(weighted)
    return out


# Thresholds of the five treatment labels in their order.
THRESHOLDS = [0.5, 0.5, 0.2, 0.2, 0.3]


def auc(scores: DataFrame, label: str, score: str) -> DataFrame:
    """Rank-sum AUC, ties at their mean rank; scores are ranked range by range (256 at most), ranges by their totals."""
    by = scores.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(label)).alias("p"), F.sum(1 - F.col(label)).alias("q"))
    cuts = by.agg(F.array_distinct(F.percentile_approx("_s", [i / 256 for i in range(1, 256)], 10_000)).alias("_cuts"))
    by = by.crossJoin(F.broadcast(cuts)).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_s")))).drop("_cuts")
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = by.groupBy("_b").agg(F.sum("q").alias("_q")).withColumn("_before", F.coalesce(F.sum("_q").over(earlier), F.lit(0))).select("_b", "_before")
    within = F.coalesce(F.sum("q").over(Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = by.withColumn("_w", within).join(F.broadcast(totals), "_b")
    return by.withColumn("w", F.col("p") * (F.col("_before") + F.col("_w") + F.col("q") / 2)).agg((F.sum("w") / (F.sum("p") * F.sum("q"))).alias("auc"))


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, missing_rate): null, empty, unknown and none count as missing."""
    bad = lambda c: F.coalesce(F.lower(F.col(c).cast("string")).isin("", "unknown", "none"), F.lit(True)).cast("double")
    one = df.agg(*[F.avg(bad(c)).alias(c) for c in columns])
    return one.unpivot([], columns, "field", "missing_rate")


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n, share) of categories; aggregated before the share, so a window holds values, not rows."""
    long = df.select(*[F.col(c).cast("string") for c in columns]).unpivot([], columns, "field", "value")
    by = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def margin_loss(pos: Column, neg: Column, margin: float = 0.4) -> Column:
    return F.greatest(margin - (pos - neg), F.lit(0.0))


def gate_loss(gate: Column, graph: tuple[Column, Column], semantic: tuple[Column, Column], complex_: Column, margin: float = 0.4, weight: float = 3.0, penalty: float = 0.2) -> Column:
    """Margin loss of the gated score of a positive over a negative, complex cases weighed, and a penalty on the gate."""
    pos, neg = (gate * g + (1 - gate) * s for g, s in zip(graph, semantic, strict=True))
    return margin_loss(pos, neg, margin) * F.when(complex_, weight).otherwise(1.0) + penalty * gate


def save_models(models: dict, path: str) -> None:
    """Fitted pipelines by label, a folder each."""
    for label, model in models.items():
        model.write().overwrite().save(f"{path.rstrip('/')}/{label}")


def load_models(path: str, labels: list[str]) -> dict:
    from pyspark.ml import PipelineModel

    return {label: PipelineModel.load(f"{path.rstrip('/')}/{label}") for label in labels}


def cross_validated(df: DataFrame, features: list[str], labels: list[str], key: str, n: int = 5, kind: str = "gbt", **params) -> DataFrame:
    """(key, fold, truth, guess): each fold predicted by models fitted to the others only; label thresholds as fixed above, 0.5 beyond."""
    from pyspark.ml.functions import vector_to_array

    dealt, out = folds(df, labels[0], key, n), None
    for fold in range(n):
        models = fit_labels(dealt.filter(F.col("fold") != fold), features, labels, kind, **params)
        rows = dealt.filter(F.col("fold") == fold)
        for label in labels:
            scored = models[label].transform(rows)
            rows = scored.withColumn(f"_p_{label}", vector_to_array("probability")[1]).drop("_f", "rawPrediction", "probability", "prediction")
        cut = dict(zip(labels, THRESHOLDS, strict=False))
        guess = F.array(*[(F.col(f"_p_{x}") >= cut.get(x, 0.5)).cast("int") for x in labels])
        now = rows.select(key, "fold", F.array(*[F.col(x).cast("int") for x in labels]).alias("truth"), guess.alias("guess"))
        out = now if out is None else out.unionByName(now)
    return out


def contrastive_loss(pos: Column, negs: Column, temperature: float = 0.15) -> Column:
    """InfoNCE of one positive among its negatives."""
    total = F.aggregate(F.transform(negs, lambda x: F.exp(x / temperature)), F.lit(0.0), lambda a, x: a + x)
    return -F.log(F.exp(pos / temperature) / (F.exp(pos / temperature) + total))


def padded_negatives(negs: Column, n: int = 3) -> Column:
    """First n, the last one repeated where there are fewer; empty stays empty."""
    fill = F.when(F.size(negs) > 0, F.array_repeat(F.try_element_at(negs, F.lit(-1)), n)).otherwise(F.slice(negs, 1, n))
    return F.slice(F.concat(negs, fill), 1, n)


def both_languages(rows: DataFrame) -> DataFrame:
    """A row for each anchor that is present."""
    return rows.withColumn("anchor", F.explode(F.filter(F.array("anchor_cn", "anchor_en"), lambda x: x.isNotNull() & (x != "")))).drop("anchor_cn", "anchor_en")
