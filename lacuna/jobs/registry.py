"""Model registry as a small table."""

from __future__ import annotations

from math import prod
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.jobs.config import load_config
from lacuna.operators.gnn import Weights


def registry(spark: SparkSession, path: str | Path) -> DataFrame:
    """(name, description, in_channels, hidden, out_channels, heads, features, tags) of a registry file and its model files."""
    rows = []
    for name, entry in load_config(path)["models"].items():
        spec = load_config(Path(path).parent / entry.get("folder", "configs") / entry["config"])
        a = spec.get("architecture", {})
        rows.append((name, entry.get("description", ""), a.get("in_channels"), a.get("hidden_layers"), a.get("out_channels"), a.get("heads"), spec.get("input_features") or ["density", "temperature"], [str(t) for t in spec.get("metadata", {}).get("tags", [])]))
    return spark.createDataFrame(rows, "name string, description string, in_channels int, hidden int, out_channels int, heads int, features array<string>, tags array<string>")


def list_models(models: DataFrame, tags: list[str] | None = None, part: str | None = None) -> DataFrame:
    """Models that have any of the tags and whose lower-cased name contains part."""
    if tags:
        models = models.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return models.where(F.contains(F.lower("name"), F.lit(part.lower()))) if part else models


def load_weights(parameters: DataFrame, model: dict) -> Weights:
    """Weights of a model (a row of get_model) from a table (name, parameter, i, j, value) of all models' parameters.

    Vectors have j 0. Shapes are those of the architecture; a missing, repeated or surplus value raises.
    """
    hidden, out, heads, channels = model["hidden"], model["out_channels"], model["heads"], model["in_channels"]
    shapes = {n: (hidden,) for n in ("bias", "gamma", "beta", "mean", "var")} | {"root": (hidden, channels), "rel": (hidden, channels), "attention": (heads, out)}
    shapes |= {"left": (heads * out, hidden), "right": (heads * out, hidden), "left_bias": (heads * out,), "right_bias": (heads * out,), "last": (out,)}
    rows = parameters.where(F.lower("name") == model["name"].lower()).select("parameter", "i", "j", "value").limit(sum(map(prod, shapes.values())) + 1).collect()
    got: dict = {n: np.full(s, np.nan) for n, s in shapes.items()}
    for r in rows:
        if r["parameter"] not in got:
            raise ValueError(f"unknown parameter {r['parameter']!r}")
        at = (r["i"], r["j"])[: len(shapes[r["parameter"]])]
        if not all(0 <= k < n for k, n in zip(at, shapes[r["parameter"]], strict=True)) or not np.isnan(got[r["parameter"]][at]):
            raise ValueError(f"{r['parameter']}{list(at)} is repeated or outside {shapes[r['parameter']]}")
        got[r["parameter"]][at] = r["value"]
    if gaps := [n for n, x in got.items() if np.isnan(x).any()]:
        raise ValueError(f"values are missing of {', '.join(gaps)}")
    return Weights(**got)


def get_model(models: DataFrame, name: str) -> dict:
    """One model's row, by name in any case; an unknown name raises with those that there are."""
    found = models.where(F.lower("name") == name.lower()).take(1)
    if not found:
        raise KeyError(f"unknown model {name!r}; known are {', '.join(sorted(r['name'] for r in models.select('name').collect()))}")
    return found[0].asDict()
