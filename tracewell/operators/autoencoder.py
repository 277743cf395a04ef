"""Anomaly scores by a variational autoencoder of windows, conditioned on a node's kind and layer.

It is fitted in numpy on a bounded sample of windows of clean runs; every window of every series is scored by its
squared error, with the latent values at their mean, so that scores do not vary from run to run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import NODE
from .learned import WIDTH, node_scores, sampled, windows
from .lineage import TRANSFER
from .networks import Adam, backward, dense, forward

KINDS = tuple(TRANSFER)
LAYERS = 5
CONDITION = len(KINDS) + LAYERS
LATENT, HIDDEN = 8, 64
#: Windows that the model is fitted on at most.
SAMPLE = 20_000


@dataclass
class Autoencoder:
    """``decoders`` is one for all kinds, or one for each; ``told`` says whether decoders see the condition."""

    encoder: list[np.ndarray]
    decoders: list[list[np.ndarray]]
    told: bool

    def error(self, x: np.ndarray, condition: np.ndarray) -> np.ndarray:
        mean = forward(self.encoder, np.hstack([x, condition]))[-1][:, :LATENT]
        out = np.zeros_like(x)
        for rows, decoder in self.parts(condition):
            out[rows] = forward(decoder, self.given(mean[rows], condition[rows]))[-1]
        return ((out - x) ** 2).mean(axis=1)

    def parts(self, condition: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        if len(self.decoders) == 1:
            return [(np.arange(len(condition)), self.decoders[0])]
        kind = condition[:, : len(KINDS)].argmax(axis=1)
        return [(np.flatnonzero(kind == k), d) for k, d in enumerate(self.decoders)]

    def given(self, z: np.ndarray, condition: np.ndarray) -> np.ndarray:
        return np.hstack([z, condition]) if self.told else z

    def of(self, frame: pd.DataFrame) -> np.ndarray:
        return self.error(np.stack(frame.w), conditions(frame))


def conditions(frame: pd.DataFrame) -> np.ndarray:
    """One place for each kind (unknown: source) and layer (unknown: 3)."""
    out = np.zeros((len(frame), CONDITION))
    kind = frame.transform_type.map({k: i for i, k in enumerate(KINDS)}).fillna(0).to_numpy(int)
    layer = frame.layer.fillna(3).clip(1, LAYERS).to_numpy(int)
    out[np.arange(len(frame)), kind] = 1.0
    out[np.arange(len(frame)), len(KINDS) + layer - 1] = 1.0
    return out


def loss(model: Autoencoder, x: np.ndarray, condition: np.ndarray, noise: np.ndarray, beta: float = 0.5) -> tuple[float, list[np.ndarray]]:
    """Mean squared error + ``beta`` x divergence from the unit normal, and the gradients (encoder, then decoders)."""
    deep = forward(model.encoder, np.hstack([x, condition]))
    mean, log_var = deep[-1][:, :LATENT], deep[-1][:, LATENT:]
    dev = np.exp(log_var / 2)
    z = mean + dev * noise
    gz, error, grads = np.zeros_like(z), 0.0, []
    for rows, decoder in model.parts(condition):
        at = forward(decoder, model.given(z[rows], condition[rows]))
        apart = at[-1] - x[rows]
        error += float((apart**2).sum()) / x.size
        g, own = backward(decoder, at, 2 * apart / x.size)
        gz[rows] = g[:, :LATENT]
        grads += own
    divergence = -0.5 * float((1 + log_var - mean**2 - dev**2).mean())
    g = np.hstack([gz + beta * mean / z.size, gz * noise * dev / 2 + beta * (dev**2 - 1) / 2 / z.size])
    return error + beta * divergence, backward(model.encoder, deep, g)[1] + grads


def fitted(x: np.ndarray, condition: np.ndarray, by_kind: bool = False, told: bool = True, epochs: int = 80, batch: int = 512, rate: float = 1e-3, seed: int = 0) -> Autoencoder:
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    inner = LATENT + (CONDITION if told else 0)
    decoders = [dense(rng, inner, HIDDEN // 2, HIDDEN, width) for _ in range(len(KINDS) if by_kind else 1)]
    model = Autoencoder(dense(rng, width + CONDITION, HIDDEN, HIDDEN // 2, 2 * LATENT), decoders, told)
    adam = Adam([*model.encoder, *(p for d in decoders for p in d)], rate)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            adam.step(loss(model, x[rows], condition[rows], rng.normal(size=(len(rows), LATENT)))[1])
    return model


def autoencoder_scores(series: DataFrame, clean: DataFrame, nodes: DataFrame, by_kind: bool = False, told: bool = True, sample: int = SAMPLE, epochs: int = 80, width: int = WIDTH) -> DataFrame:
    """(run_id, node_id, score) of every node of ``series``, by a model of ``clean`` (series of clean runs). ``by_kind``
    gives each kind of node a decoder of its own; those see the condition as well if ``told``. Nodes that ``nodes`` does
    not list count as sources of layer 3; nodes without windows score 0."""
    meta = F.broadcast(nodes.select("node_id", "transform_type", "layer"))  # one topology's nodes

    def rows(s: DataFrame) -> DataFrame:
        return windows(s, width).join(meta, "node_id", "left").select(*NODE, "t", "w", "transform_type", "layer")

    some = sampled(rows(clean), sample)
    if some.empty:
        return series.select(*NODE).distinct().withColumn("score", F.lit(0.0))
    model = fitted(np.stack(some.w), conditions(some), by_kind, told, epochs)
    return node_scores(series, rows(series), model, model.of(some))
