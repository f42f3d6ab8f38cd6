"""Canonical tables built from the driver's tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import clinical
from quillgraph.session import dealt, table

def _role():
    return F.when(F.col("l_returnflag") == "A", "CONDITION").when(F.col("l_returnflag") == "N", "RECOMMENDATION").otherwise("EVIDENCE")


ROLE_SQL = "CASE l_returnflag WHEN 'A' THEN 'CONDITION' WHEN 'N' THEN 'RECOMMENDATION' ELSE 'EVIDENCE' END"


def links(spark: SparkSession, d: str) -> DataFrame:
    """Unmerged incidence; pos orders rows as written."""
    order = F.struct("l_shipdate", "l_linenumber", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hyperedge"), F.col("l_partkey").alias("entity"), _role().alias("role"), F.col("l_quantity").alias("weight"), order.alias("pos"), F.col("l_linestatus").alias("entity_type"))


def incidence(spark: SparkSession, d: str) -> DataFrame:
    """One row a (hyperedge, entity): strongest role by name, summed weight; those of a hyperedge stay in one task."""
    return dealt(links(spark, d), "hyperedge").groupBy("hyperedge", "entity").agg(F.max("role").alias("role"), F.sum("weight").alias("weight"))


LINKS = f"SELECT l_orderkey AS hyperedge, l_partkey AS entity, {ROLE_SQL} AS role, l_quantity AS weight, l_linestatus AS entity_type, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate, l_linenumber, l_suppkey, l_extendedprice, l_discount, l_tax) AS pos FROM lineitem"
INCIDENCE = f"SELECT l_orderkey AS hyperedge, l_partkey AS entity, max({ROLE_SQL}) AS role, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2"
BELONGS = "SELECT o_custkey AS paper, o_orderkey AS hyperedge FROM orders"


def belongs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_custkey").alias("paper"), F.col("o_orderkey").alias("hyperedge"))


def share_of_price():
    """The order's price as a share of 500,000; the product is rounded, as DuckDB does, so that binary ties fall as they do there."""
    return F.round(F.col("o_totalprice") / 500000 * 10000) / 10000


def hyperedge_scores(spark: SparkSession, d: str) -> DataFrame:
    """A deterministic stand-in for a trained scorer: the order's price as a share of 500,000."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("hyperedge"), share_of_price().alias("score"))


def scorer_output(spark: SparkSession, d: str) -> DataFrame:
    """What a scorer gives in practice: hyperedges of cheap orders score 0, those of pending orders have no score."""
    priced = F.when(F.col("o_totalprice") >= 100000, share_of_price()).otherwise(0.0)
    return table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("hyperedge"), priced.cast("double").alias("score"))


SCORED = "SELECT o_orderkey AS hyperedge, CASE WHEN o_totalprice >= 100000 THEN round(o_totalprice / 500000, 4) ELSE 0 END::DOUBLE AS score FROM orders WHERE o_orderstatus <> 'P'"
SCORES = "SELECT o_orderkey AS hyperedge, round(o_totalprice / 500000, 4) AS score FROM orders"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as a query."""
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def patients(spark: SparkSession, d: str) -> DataFrame:
    """Patients from customers: each field walks its values with the key, at a stride of its own."""
    key = F.col("c_custkey")
    pick = lambda values, stride: F.element_at(F.array(*map(F.lit, values)), (F.floor(key / stride) % len(values) + 1).cast("int"))
    fields = {f: pick(values, s) for (f, values), s in zip(clinical.ALLOWED.items(), (1, 1, 2, 3, 7, 5, 11, 4, 6), strict=True)}
    depth = F.when(key % 3 == 0, 0.0).when(key % 3 == 1, 4.5)
    flags = {k: (F.floor(key / (i + 2)) % 2).cast("int") for i, k in enumerate(clinical.COMORBIDITIES)}
    return table(spark, d, "customer").select(
        key.alias("id"),
        (30 + key % 60).cast("int").alias("age"),
        *[c.alias(f) for f, c in fields.items()],
        depth.cast("double").alias("myometrial_invasion_depth"),
        (F.floor(key / 13) % 2).cast("int").alias("lvsi_substantial"),
        (F.floor(key / 17) % 2).cast("int").alias("adnexal_involvement"),
        *[c.alias(f) for f, c in flags.items()],
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def _pick(values: list[str], stride: int) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[((c_custkey // {stride}) % {len(values)} + 1)::INT]"


PATIENTS = (
    "SELECT c_custkey AS id, (30 + c_custkey % 60)::INT AS age, "
    + ", ".join(f"{_pick(values, s)} AS {f}" for (f, values), s in zip(clinical.ALLOWED.items(), (1, 1, 2, 3, 7, 5, 11, 4, 6), strict=True))
    + ", CASE c_custkey % 3 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 4.5::DOUBLE END AS myometrial_invasion_depth, ((c_custkey // 13) % 2)::INT AS lvsi_substantial, ((c_custkey // 17) % 2)::INT AS adnexal_involvement, "
    + ", ".join(f"((c_custkey // {i + 2}) % 2)::INT AS {k}" for i, k in enumerate(clinical.COMORBIDITIES))
    + ", c_acctbal AS balance, c_mktsegment AS segment FROM customer"
)
