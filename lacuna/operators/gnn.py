"""Graph network scoring: mean GraphConv, batch norm, ReLU and GATv2, with weights that the caller supplies."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import ball
from lacuna.operators.graph import Within
from lacuna.sources.staging import held_settings, stage

#: A chunk of at most so many edge ends is scored in one task, without a shuffle between the message rounds.
LOCAL_ROWS = 200_000_000


@dataclass
class Weights:
    """One GraphConv (root, rel, bias), its batch norm in evaluation form, and one GATv2 layer.

    Shapes: root, rel (hidden, in); bias, gamma, beta, mean, var (hidden); left, right (heads * out,
    hidden) with their biases; attention (heads, out); last (out, or heads * out if the heads are concatenated).
    """

    root: np.ndarray
    rel: np.ndarray
    bias: np.ndarray
    gamma: np.ndarray
    beta: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    left: np.ndarray
    left_bias: np.ndarray
    right: np.ndarray
    right_bias: np.ndarray
    attention: np.ndarray
    last: np.ndarray
    concat: bool = False
    eps: float = 1e-5
    slope: float = 0.2

    @classmethod
    def from_dict(cls, d: dict) -> Weights:
        return cls(**{k: np.asarray(v, float) if isinstance(v, list) else v for k, v in d.items()})


def neighbour_means(nodes: DataFrame, adj: DataFrame, names: list[str]) -> DataFrame:
    """nodes with mean_<name>: mean over the neighbours, 0 where there are none."""
    sent = nodes.select(F.col("node_id").alias("nbr"), *names)
    got = adj.join(sent, "nbr").groupBy(F.col("node").alias("node_id")).agg(*[F.avg(n).alias(f"mean_{n}") for n in names])
    return nodes.join(got, "node_id", "left").na.fill(0.0, [f"mean_{n}" for n in names])


def _dense(nodes: DataFrame, names: list[str], w: Weights) -> DataFrame:
    """(node_id, l0.., r0..): the hidden layer and both attention projections of each node, by matrix products in Arrow batches."""
    width = len(w.left)
    shared = nodes.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        for pdf in batches:
            x, m = pdf[names].to_numpy(), pdf[[f"mean_{n}" for n in names]].to_numpy()
            h = x @ w.root.T + m @ w.rel.T + w.bias
            h = np.maximum((h - w.mean) / np.sqrt(w.var + w.eps) * w.gamma + w.beta, 0)
            out = np.concatenate([h @ w.left.T + w.left_bias, h @ w.right.T + w.right_bias], axis=1)
            yield pd.concat([pdf[["node_id"]].reset_index(drop=True), pd.DataFrame(out, columns=[f"{s}{k}" for s in "lr" for k in range(width)])], axis=1)

    cols = ", ".join(f"{s}{k} double" for s in "lr" for k in range(width))
    return nodes.select("node_id", *names, *[f"mean_{n}" for n in names]).mapInPandas(run, f"node_id long, {cols}")


def forward(nodes: DataFrame, adj: DataFrame | Within, names: list[str], w: Weights) -> DataFrame:
    """(node_id, o0, o1, ...): output of the network for each node; adj is symmetric and without loops, or a radius around the nodes' x, y, z.

    Both message rounds are joins and map-side combined sums over scalar columns. Attention is a softmax
    over the neighbours and the node itself: first the largest logit of each head, then sums shifted by it. Of a
    radius no pair is written (ball.forward).
    """
    if isinstance(adj, Within):
        return ball.forward(nodes, adj.r, names, w)
    heads, out = w.attention.shape
    made = _dense(neighbour_means(nodes, adj, names), names, w)
    left = [f"l{k}" for k in range(heads * out)]
    right = [f"r{k}" for k in range(heads * out)]
    loops = made.select("node_id", F.col("node_id").alias("nbr"))
    pairs = adj.select(F.col("node").alias("node_id"), "nbr").unionByName(loops)
    sent = pairs.join(made.select(F.col("node_id").alias("nbr"), *left), "nbr").join(made.select("node_id", *right), "node_id")
    sent = sent.select("node_id", *left, *_logits(w))
    top = sent.groupBy("node_id").agg(*[F.max(f"e{h}").alias(f"m{h}") for h in range(heads)])
    sent = sent.join(top, "node_id")
    return sent.groupBy("node_id").agg(*_attended(w)).select("node_id", *_outputs(w))


def _logits(w: Weights) -> list[Column]:
    """e0, e1, ...: attention logit of each head from the sender's l and the receiver's r."""
    heads, out = w.attention.shape

    def logit(h: int):
        total = F.lit(0.0)
        for o in range(out):
            k = h * out + o
            s = F.col(f"l{k}") + F.col(f"r{k}")
            total = total + F.when(s > 0, s).otherwise(s * w.slope) * float(w.attention[h, o])
        return total

    return [logit(h).alias(f"e{h}") for h in range(heads)]


def _attended(w: Weights) -> list[Column]:
    """Aggregates z (of weights) and s (of weighted l), from logits e and their largest m."""
    heads, out = w.attention.shape
    parts = []
    for h in range(heads):
        a = F.exp(F.col(f"e{h}") - F.col(f"m{h}"))
        parts.append(F.sum(a).alias(f"z{h}"))
        parts += [F.sum(a * F.col(f"l{h * out + o}")).alias(f"s{h * out + o}") for o in range(out)]
    return parts


def _outputs(w: Weights) -> list[Column]:
    heads, out = w.attention.shape
    if w.concat:
        cols = [(F.col(f"s{h * out + o}") / F.col(f"z{h}") + float(w.last[h * out + o])).alias(f"o{h * out + o}") for h in range(heads) for o in range(out)]
    else:
        cols = []
        for o in range(out):
            total = F.lit(0.0)
            for h in range(heads):
                total = total + F.col(f"s{h * out + o}") / F.col(f"z{h}")
            cols.append((total / heads + float(w.last[o])).alias(f"o{o}"))
    return cols


def _layer(x: str, matrix: np.ndarray, bias: np.ndarray) -> str:
    """SQL of matrix @ x + bias for an array column x, native, so that the partitioning of its rows is kept."""
    rows = ", ".join(f"struct(array({', '.join(f'{v!r}D' for v in map(float, row))}) AS w, {float(b)!r}D AS b)" for row, b in zip(matrix, bias, strict=True))
    return f"transform(array({rows}), r -> aggregate(zip_with(r.w, {x}, (p, q) -> p * q), r.b, (s, v) -> s + v))"


def forward_in_chunks(nodes: DataFrame, edges: DataFrame, names: list[str], w: Weights, local: bool = True) -> DataFrame:
    """(chunk, node_id, o0, o1, ...): the network on each chunk's own graph, as if the other chunks weren't there.

    nodes: (chunk, node_id, names...), one row for each node a chunk holds. edges: (chunk, src, dst) as they come, by
    chunk; loops, repeats, direction and ends that the chunk doesn't hold don't matter. Everything is keyed by (chunk, node). With
    local, both tables are dealt by chunk once, and neither message round shuffles, as every key contains the
    chunk; without, rows are dealt by (chunk, node), so that a chunk may be of any size. The caller's session must
    hold the setting of score_chunks for the first to take effect.
    """
    heads, out = w.attention.shape
    scale = w.gamma / np.sqrt(w.var + w.eps)
    rows = nodes.select("chunk", "node_id", F.array(*[F.col(n).cast("double") for n in names]).alias("x"))
    # Each node's loop, for the attention, comes along with the edges: a later union would lose the partitioning.
    pairs = edges.where("src <> dst").select("chunk", "src", "dst").unionByName(rows.select("chunk", F.col("node_id").alias("src"), F.col("node_id").alias("dst")))
    if local:
        rows, pairs = rows.repartition("chunk"), pairs.repartition("chunk")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("nbr")))).alias("e")
    looped = pairs.select("chunk", ends).select("chunk", "e.node_id", "e.nbr").distinct()
    adj = looped.where("node_id <> nbr")
    met = adj.join(rows.select("chunk", F.col("node_id").alias("nbr"), "x"), ["chunk", "nbr"])
    means = met.groupBy("chunk", "node_id").agg(F.array(*[F.avg(F.col("x")[k]) for k in range(len(names))]).alias("m"))
    both = rows.join(means, ["chunk", "node_id"], "left")
    both = both.withColumn("x", F.concat("x", F.coalesce("m", F.array(*[F.lit(0.0)] * len(names)))))
    hidden = _layer("x", np.hstack([w.root, w.rel]) * scale[:, None], (w.bias - w.mean) * scale + w.beta)
    made = both.select("chunk", "node_id", F.expr(f"transform({hidden}, h -> greatest(h, 0D))").alias("h"))
    made = made.select("chunk", "node_id", F.expr(_layer("h", w.left, w.left_bias)).alias("l"), F.expr(_layer("h", w.right, w.right_bias)).alias("r"))
    sent = looped.join(made.select("chunk", F.col("node_id").alias("nbr"), "l"), ["chunk", "nbr"]).join(made.select("chunk", "node_id", "r"), ["chunk", "node_id"])
    width = range(heads * out)
    sent = sent.select("chunk", "node_id", *[F.col("l")[k].alias(f"l{k}") for k in width], *[F.col("r")[k].alias(f"r{k}") for k in width])
    sent = sent.select("chunk", "node_id", *[f"l{k}" for k in width], *_logits(w))
    of = Window.partitionBy("chunk", "node_id")
    sent = sent.select("*", *[F.max(f"e{h}").over(of).alias(f"m{h}") for h in range(heads)])
    return sent.groupBy("chunk", "node_id").agg(*_attended(w)).select("chunk", "node_id", *_outputs(w))


def score_chunks(features: DataFrame, held: DataFrame, edges: DataFrame | Within, names: list[str], w: Weights, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """(node_id, score) of the nodes that chunks hold: each chunk is scored on its own raw edges, and of a node in several the highest chunk counts.

    features: (node_id, names...) of all nodes. held: (chunk, node_id), halos included. edges: (chunk, src, dst), or a radius: the pairs of
    a chunk's nodes that are closer, by features' x, y, z; no pair is written then. Nodes that
    features doesn't have are no part of a chunk, and nodes of no chunk get no row. A chunk is the unit of work
    (masks.chunk_count sizes them); if one has over local_rows edge ends, rounds are dealt by (chunk, node) instead.
    """
    if isinstance(edges, Within):
        nodes = stage(held.select("chunk", "node_id").distinct().join(features.select("node_id", *ball.AXES, *names), "node_id"), "held")
        return last_chunk_wins(softmax_score(ball.forward(nodes, edges.r, names, w, ("chunk",)), w.attention.shape[1], keep=("chunk", "node_id")))
    nodes = stage(held.select("chunk", "node_id").distinct().join(features.select("node_id", *names), "node_id"), "held")
    edges = stage(edges.select("chunk", "src", "dst"), "chunk_edges")
    most = edges.groupBy("chunk").count().agg(F.max("count")).first()[0] or 0
    local = 2 * most <= local_rows
    with held_settings(nodes.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false"} if local else {}):
        scored = softmax_score(forward_in_chunks(nodes, edges, names, w, local), w.attention.shape[1], keep=("chunk", "node_id"))
        scored = stage(scored, "chunk_scores")
    return last_chunk_wins(scored)


def softmax_score(outputs: DataFrame, classes: int = 2, positive: int = 0, keep: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """(node_id, score), or other columns kept: probability of the positive class (the first)."""
    top = F.greatest(*[F.col(f"o{k}") for k in range(classes)]) if classes > 1 else F.col("o0")
    total = sum((F.exp(F.col(f"o{k}") - top) for k in range(classes)), F.lit(0.0))
    return outputs.select(*keep, (F.exp(F.col(f"o{positive}") - top) / total).alias("score"))


def sigmoid_score(outputs: DataFrame) -> DataFrame:
    """(node_id, score) of a single logit."""
    return outputs.select("node_id", (1 / (1 + F.exp(-F.col("o0")))).alias("score"))


def best_over_scales(scores: DataFrame) -> DataFrame:
    """(node_id, score): the largest score over all scales."""
    return scores.groupBy("node_id").agg(F.max("score").alias("score"))


def last_chunk_wins(scores: DataFrame) -> DataFrame:
    """(node_id, score) of overlapping chunks (node_id, chunk, score): the highest chunk's."""
    return scores.groupBy("node_id").agg(F.max_by("score", "chunk").alias("score"))
