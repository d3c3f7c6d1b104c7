"""Where a user's own detector, encoder, ranking or perturbation enters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitlake.operators.raster import change_score


def detect(pairs: DataFrame, score: Callable[[], Column] = change_score, tau: float | None = None) -> DataFrame:
    """Pixel pairs with ``score``, which has to be in [0, 1] (else the job fails), and ``hit`` at ``tau``."""
    p = score()
    checked = F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("a score outside [0, 1]")).cast("double"))
    out = pairs.withColumn("score", checked)
    return out if tau is None else out.withColumn("hit", (F.col("score") >= tau).cast("int"))


def encode(rows: DataFrame, vectors: Callable[[pd.Series], np.ndarray], dim: int) -> DataFrame:
    """(id, vector) of (id, text): ``vectors`` maps a batch of texts to rows, scaled here to length 1 (zeros stay)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = np.asarray(vectors(batch["text"].fillna("")), "float64").reshape(len(batch), -1)
            if v.shape[1] != dim and len(batch):
                raise ValueError(f"{v.shape[1]} values where {dim} were promised")
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"id": batch["id"], "vector": list(v.astype("float32"))})

    return rows.select("id", "text").mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<float>")


def rank(queries: DataFrame, gallery: DataFrame, ranking: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What ``ranking`` makes of queries and gallery; it has to give query, id and score."""
    out = ranking(queries, gallery)
    missing = {"query", "id", "score"} - set(out.columns)
    if missing:
        raise ValueError(f"the ranking lacks {sorted(missing)}")
    return out


#: Family: (severities, change of a channel in 0 to 255).
FAMILIES: dict[str, tuple[tuple[float, ...], Callable[[Column, float], Column]]] = {
    "illumination": ((0.05, 0.15, 0.25), lambda v, s: v + 255 * s),
    "contrast": ((0.7, 1.3), lambda v, s: (v - 127.5) * s + 127.5),
}


def register_perturbation(family: str, severities: tuple[float, ...], change: Callable[[Column, float], Column]) -> None:
    FAMILIES[family] = (severities, change)


def perturb(pairs: DataFrame, family: str, severity: float, target: str = "t2") -> DataFrame:
    """Pairs with one image changed, held within 0 to 255; an unknown severity or target is an error."""
    severities, change = FAMILIES[family]
    if severity not in severities:
        raise ValueError(f"{family} has the severities {severities}")
    if target not in ("t1", "t2"):
        raise ValueError("the target is t1 or t2")
    held = lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), v))
    return pairs.withColumns({c + target[1]: held(change(F.col(c + target[1]), severity)) for c in "rgb"})
