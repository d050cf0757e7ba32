"""Calibration of head scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.fixed import labels as fixed
from riskweave.fixed.labels import HEADS
from riskweave.functions.hashing import uniform
from riskweave.functions.text import contains_any, count_contained, logit, named_flags, sigmoid
from riskweave.session import reliable_checkpoint


def _per_head(scores: Column, change) -> Column:
    return F.struct(*[change(h, scores[h]).alias(h) for h in HEADS])


def apply_temperature(
    df: DataFrame, temperatures: dict[str, float] | None = None, biases: dict[str, float] | None = None,
    scores: str = "scores", out: str = "calibrated",
) -> DataFrame:
    """sigmoid(logit / T + b) per head."""
    t, b = temperatures or fixed.CALIBRATED_TEMPERATURES, biases or fixed.CALIBRATED_BIASES
    change = lambda h, p: sigmoid(logit(p, fixed.LOGIT_CLIP) / t[h] + b[h])
    return df.withColumn(out, _per_head(F.col(scores), change))


def bias_shift(df: DataFrame, shift: dict[str, float] | None = None, scores: str = "scores", out: str = "calibrated") -> DataFrame:
    """A constant added to each head's logit."""
    by = shift or fixed.BIAS_SHIFT
    return df.withColumn(out, _per_head(F.col(scores), lambda h, p: sigmoid(logit(p, fixed.LOGIT_CLIP) + by[h])))


def content_calibration(df: DataFrame, scores: str = "scores", out: str = "calibrated") -> DataFrame:
    """Each risk list found in the text or recipients raises its head by min(.2 x hits, weight), up to .99; adds
    ``detected_risks``. Needs subject, body, attachments, recipients."""
    names = F.array_join(F.transform("attachments", lambda a: a["name"]), " ")
    text = F.concat_ws("\n", F.lower(F.concat_ws(" ", "subject", "body", names)), F.lower(F.array_join("recipients", " ")))
    hits = {name: count_contained(text, words) for name, (_, _, words) in fixed.CONTENT_RISKS.items()}
    counted = df.withColumn("_hits", F.struct(*[c.alias(n) for n, c in hits.items()]))
    boost = {
        head: F.least(F.col(f"_hits.{name}") * fixed.CONTENT_STEP, F.lit(weight))
        for name, (head, weight, _) in fixed.CONTENT_RISKS.items()
    }
    return counted.withColumns(
        {
            out: _per_head(F.col(scores), lambda h, p: F.least(p + boost[h], F.lit(fixed.CONTENT_CAP))),
            "detected_risks": named_flags({n: F.col(f"_hits.{n}") > 0 for n in hits}),
        }
    ).drop("_hits")


def heuristic_scores(df: DataFrame, seed: int = 42, noise: float = 0.05, out: str = "scores") -> DataFrame:
    """Scores from recipients, attachments, keywords and length, with repeatable noise."""
    content = F.concat_ws(" ", "body", "subject")
    lower = F.lower(content)
    outside = F.size(F.filter("recipients", lambda r: ~r.endswith(".com") | contains_any(r, ["gmail", "yahoo", "hotmail"])))
    large = F.size(F.filter("attachments", lambda a: a["size"] > fixed.LARGE_ATTACHMENT))
    sensitive = count_contained(lower, ["ssn", "password", "confidential", "secret"])
    raw = {
        "sensitivity": F.least(0.1 + sensitive * 0.25 + large * 0.15, F.lit(0.95)),
        "exposure": F.least(0.05 + outside * 0.3 + F.size("recipients") * 0.1, F.lit(0.9)),
        "context": F.least(0.02 + F.length(content) / 5000, F.lit(0.8)),
        "obfuscation": F.least(0.01 + lower.contains("urgent").cast("int") * 0.4, F.lit(0.6)),
    }
    drawn = lambda h: (uniform(seed, "heuristic", h, F.col("msg_id")) * 2 - 1) * noise
    return df.withColumn(
        out,
        F.struct(*[F.greatest(F.lit(0.001), F.least(F.lit(0.99), v + drawn(h))).alias(h) for h, v in raw.items()]),
    )


# -- fitting ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TemperatureFit:
    temperatures: dict[str, float]
    biases: dict[str, float]
    loss: float
    steps: int
    converged: bool = True  # False: the last step still brought something


def _bounded(params: np.ndarray) -> np.ndarray:
    n = len(HEADS)
    low = [fixed.TEMPERATURE_BOUNDS[0]] * n + [fixed.BIAS_BOUNDS[0]] * n
    high = [fixed.TEMPERATURE_BOUNDS[1]] * n + [fixed.BIAS_BOUNDS[1]] * n
    return np.clip(params, low, high)


def fit_temperature(df: DataFrame, target: str = "expected", scores: str = "scores", max_steps: int = 12) -> TemperatureFit:
    """Four temperatures and four biases minimising the squared error of the weighted risk against a target.

    Damped Gauss-Newton: every step is one aggregate over the (logits, target) table, which returns the sums of the
    8 x 8 normal equations; a second aggregate scores several dampings at once. Only those sums reach the driver.
    """
    heads, n = HEADS, len(HEADS)
    narrow = df.select(*[logit(F.col(f"{scores}.{h}"), fixed.LOGIT_CLIP).alias(h) for h in heads], F.col(target).alias("y"))
    table = reliable_checkpoint(narrow)  # read once per step

    def residual(p: np.ndarray) -> Column:
        parts = [sigmoid(F.col(h) / float(p[i]) + float(p[n + i])) * fixed.RISK_WEIGHTS[h] for i, h in enumerate(heads)]
        return sum(parts[1:], parts[0]) - F.col("y")

    def gradient(p: np.ndarray) -> list[Column]:
        slopes = []
        for i, h in enumerate(heads):
            s = sigmoid(F.col(h) / float(p[i]) + float(p[n + i]))
            slopes.append(s * (1 - s) * fixed.RISK_WEIGHTS[h])
        return [s * (-F.col(h) / float(p[i] ** 2)) for i, (h, s) in enumerate(zip(heads, slopes))] + slopes

    params = np.array([fixed.TEMPERATURE_START] * n + [0.0] * n)
    loss = table.agg(F.avg(residual(params) ** 2)).first()[0]
    steps, converged = 0, False
    for steps in range(1, max_steps + 1):
        columns = table.select(residual(params).alias("r"), *[g.alias(f"g{i}") for i, g in enumerate(gradient(params))])
        pairs = [(i, j) for i in range(2 * n) for j in range(i, 2 * n)]
        row = columns.agg(
            *[F.avg(F.col(f"g{i}") * F.col(f"g{j}")) for i, j in pairs],
            *[F.avg(F.col(f"g{i}") * F.col("r")) for i in range(2 * n)],
        ).first()
        normal = np.zeros((2 * n, 2 * n))
        for (i, j), value in zip(pairs, row):
            normal[i, j] = normal[j, i] = value
        slope = np.array(row[len(pairs) :])
        candidates = [
            _bounded(params - np.linalg.solve(normal + np.eye(2 * n) * damping, slope)) for damping in (1e-6, 1e-4, 1e-2, 1.0)
        ]
        losses = table.agg(*[F.avg(residual(c) ** 2) for c in candidates]).first()
        best = int(np.argmin(losses))
        if losses[best] >= loss * (1 - 1e-6):
            converged = True
            break
        params, loss = candidates[best], losses[best]
    return TemperatureFit(
        {h: float(params[i]) for i, h in enumerate(heads)}, {h: float(params[n + i]) for i, h in enumerate(heads)}, float(loss), steps, converged
    )
