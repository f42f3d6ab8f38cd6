"""Pluggable scorers: numpy forward passes for given weights, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numbers of the roles as a trained scorer sees them; unknown ones count as context.
ROLE_IDS = {"EVIDENCE": 0, "CONTEXT": 1, "CONDITION": 2, "RECOMMENDATION": 3, "CONTRAINDICATION": 4}


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    mean, var = x.mean(-1, keepdims=True), x.var(-1, keepdims=True)
    return (x - mean) / np.sqrt(var + 1e-5) * gain + bias


def dense(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Linear layers with GELU between them."""
    for k, (w, b) in enumerate(layers):
        x = x @ w + b
        x = gelu(x) if k + 1 < len(layers) else x
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def attention_score(query: np.ndarray, members: np.ndarray, roles: np.ndarray, w: dict) -> float:
    """Score of a hyperedge's members (n, dim) for a query: normalised role-aware states, self-attention, comparison heads, mean over members and heads."""
    h0 = layer_norm(members + w["roles"][roles] * w["scale"], w["g0"], w["b0"])
    heads, dim = w["heads"], members.shape[1]
    part = lambda m: (h0 @ w[m]).reshape(len(h0), heads, dim // heads).transpose(1, 0, 2)
    logits = part("wq") @ part("wk").transpose(0, 2, 1) / np.sqrt(dim // heads)
    share = np.exp(logits - logits.max(-1, keepdims=True))
    share /= share.sum(-1, keepdims=True)
    mixed = (share @ part("wv")).transpose(1, 0, 2).reshape(len(h0), dim) @ w["wo"]
    h1 = layer_norm(h0 + mixed, w["g1"], w["b1"])
    q, k, raw = gelu(query @ w["q"]), gelu(h1 @ w["k"]), gelu(members @ w["k"])
    q = np.broadcast_to(q, k.shape)
    cut = lambda m: m.reshape(len(h0), heads, -1)
    compared = np.concatenate([cut(q), cut(k), np.abs(cut(q) - cut(k)), np.abs(cut(q) - cut(raw)), cut(q) * cut(k)], -1)
    return float(sigmoid(dense(compared, w["mlp"]).mean()))


def hyperedge_scores(tensors: DataFrame, query: np.ndarray, weights: dict) -> DataFrame:
    """(hyperedge, score) of graph.padded_tensor's rows; weights are of fixed size and travel with the function."""

    def run(batches):
        for pdf in batches:
            scores = [attention_score(query, np.array([m["vector"] for m in ms], float), np.array([ROLE_IDS.get(m["role"], 1) for m in ms]), weights) for ms in pdf["members"]]
            yield pd.DataFrame({"hyperedge": pdf["hyperedge"], "score": scores})

    return tensors.mapInPandas(run, f"hyperedge {dict(tensors.dtypes)['hyperedge']}, score double")


def asked_scores(pairs: DataFrame, weights: dict) -> DataFrame:
    """(query_id, hyperedge, score) of pairs(query_id, hyperedge, vector, members): the question's vector against graph.padded_tensor's members."""

    def run(batches):
        for pdf in batches:
            scores = [attention_score(np.asarray(q, float), np.array([m["vector"] for m in ms], float), np.array([ROLE_IDS.get(m["role"], 1) for m in ms]), weights) for q, ms in zip(pdf["vector"], pdf["members"], strict=True)]
            yield pd.DataFrame({"query_id": pdf["query_id"], "hyperedge": pdf["hyperedge"], "score": scores})

    kinds = dict(pairs.dtypes)
    return pairs.select("query_id", "hyperedge", "vector", "members").mapInPandas(run, f"query_id {kinds['query_id']}, hyperedge {kinds['hyperedge']}, score double")


def surrogate_score(query: Column, members: Column) -> Column:
    """A documented stand-in where no trained weights are given: sigmoid of the mean member cosine."""
    from quillgraph.operators.vector import cosine

    total = F.aggregate(F.transform(members, lambda m: cosine(query, m["vector"])), F.lit(0.0), lambda a, x: a + x)
    return 1 / (1 + F.exp(-total / F.greatest(F.size(members), F.lit(1))))


def gate(vector: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], temperature: float = 1.0) -> float:
    """Share of the graph stream, kept within 0.02 and 0.98."""
    x = vector / (np.linalg.norm(vector) + 1e-8)
    return float(np.clip(sigmoid(dense(x, layers) / temperature), 0.02, 0.98).ravel()[0])


def pair_scores(u: np.ndarray, v: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Evidence scores of row pairs from both vectors, their difference and product."""
    return sigmoid(dense(np.concatenate([u, v, np.abs(u - v), u * v], 1), layers)).ravel()


def checked_embedder(embed: Callable[[list[str]], list[list[float]]], dim: int) -> Callable[[pd.Series], list[list[float]]]:
    """An embedder of string batches as a function of a series that checks lengths."""

    def run(texts: pd.Series) -> list[list[float]]:
        out = embed(texts.fillna("").tolist())
        if len(out) != len(texts) or any(len(v) != dim for v in out):
            raise ValueError("the embedder must give one vector of the stated size a text")
        return out

    return run


def embed_udf(embed: Callable[[list[str]], list[list[float]]], dim: int):
    """A column function around an embedder."""
    return F.pandas_udf(lambda texts: pd.Series(checked_embedder(embed, dim)(texts)), T.ArrayType(T.FloatType()))


def reranker_udf(score: Callable[[list[str], list[str]], list[float]]):
    """A column function (query, text) around a reranker of pairs; checks lengths."""

    @F.pandas_udf(T.DoubleType())
    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        out = score(queries.fillna("").tolist(), texts.fillna("").tolist())
        if len(out) != len(texts):
            raise ValueError("the reranker must give one score a pair")
        return pd.Series(out, dtype="float64")

    return run


def language_model_udf(complete: Callable[[pd.Series], pd.Series]):
    """A column function around a completion function; materialise its result before it is read twice."""
    return F.pandas_udf(complete, T.StringType())
