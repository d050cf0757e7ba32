"""Evaluation of scores, tags and decisions.

A score table is (msg_id, head, score, truth); a tag table is (msg_id, pred, truth) of id arrays, -100 ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.fixed.labels import HEADS
from riskweave.fixed.span_patterns import IGNORE_ID
from riskweave.functions import labels as L
from riskweave.functions.spans import let, tag_entities
from riskweave.functions.text import safe_corr
from riskweave.operators.positions import grouped_running


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def binary_metrics(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per head: confusion counts, precision, recall, F1 and accuracy; undefined ratios are 0."""
    pred, true = F.col("score") > threshold, F.col("truth") == 1
    counts = scores.groupBy("head").agg(
        F.count_if(pred & true).alias("tp"), F.count_if(pred & ~true).alias("fp"),
        F.count_if(~pred & ~true).alias("tn"), F.count_if(~pred & true).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    with_ratios = counts.withColumns(
        {"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp + tn, tp + fp + tn + fn)}
    )
    return with_ratios.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _tied(scores: DataFrame) -> DataFrame:
    """Positives and negatives per (head, score): ties become one point, and the table shrinks before any sort."""
    return scores.groupBy("head", "score").agg(
        F.sum((F.col("truth") == 1).cast("long")).alias("pos"), F.sum((F.col("truth") != 1).cast("long")).alias("neg")
    )


def ranking_curve(scores: DataFrame) -> DataFrame:
    """Per head and distinct score, from high to low: points, running true and false positives, and the totals.

    Running sums go over range partitions, so one head with very many distinct scores uses many tasks.
    """
    tied = _tied(scores)
    running = grouped_running(tied, ["head"], [F.desc("score")], sums={"tp": "pos", "fp": "neg"})
    # From the written copy, so the scores are not computed a second time.
    totals = running.groupBy("head").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    return running.join(totals, "head")  # totals: one row per head


def ranking_metrics(scores: DataFrame, target_recall: float = 0.95) -> DataFrame:
    """Per head: AUROC, average precision and the false-positive rate at the recall nearest to a target.

    With one class only: .5, 0 and 0. The curve ends in recall 0 (no threshold), which gives rate 0; among equal
    distances the lowest threshold wins.
    """
    curve = ranking_curve(scores)
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    area = F.sum(neg * (tp - pos) + neg * pos / 2)
    precision_steps = F.sum(pos * tp / (tp + fp))
    distance = F.abs(tp / F.col("all_pos") - F.lit(target_recall))
    best = F.min_by(F.struct(distance.alias("d"), fp.alias("fp")), F.struct(distance, "score"))
    per_head = curve.groupBy("head").agg(
        F.max("all_pos").alias("p"), F.max("all_neg").alias("n"), area.alias("area"),
        precision_steps.alias("steps"), best.alias("best"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    past_end = F.lit(abs(target_recall)) < F.col("best.d")  # the end point is nearer
    return per_head.select(
        "head",
        F.when(both, F.col("area") / (F.col("p") * F.col("n"))).otherwise(0.5).alias("auroc"),
        F.when(both, F.col("steps") / F.col("p")).otherwise(0.0).alias("auprc"),
        F.when(both & ~past_end, F.col("best.fp") / F.col("n")).otherwise(0.0).alias("fpr_at_recall"),
    )


def _bin(score: Column, bins: int) -> Column:
    """1-based bin of (low, high]; score 0 gives 0. Edges are compared as numbers, not scaled and rounded."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    return F.size(F.filter(edges, lambda e: e < score))


def calibration_curve(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Per head and non-empty uniform bin [low, high) (the last one closed): share of positives and mean score."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    number = F.size(F.filter(edges, lambda e: e <= F.col("score"))).alias("bin")
    per_bin = scores.filter("head is not null").groupBy("head", number).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("truth").alias("fraction_of_positives"),
        F.avg("score").alias("mean_predicted_value"),
        F.min("truth").alias("_low"),
        F.max("truth").alias("_high"),
    )
    # Both classes are looked for among the few bins of a head, so the scores are computed once.
    head = Window.partitionBy("head")
    both = F.min("_low").over(head) != F.max("_high").over(head)
    return per_bin.withColumn("_both", both).filter("_both").drop("_low", "_high", "_both")


def expected_calibration_error(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Per head: sum over bins (low, high] of |mean score - share of positives| x share of rows. Score 0 is in no bin
    but counts as a row; a head with one class gives 0."""
    per_bin = scores.groupBy("head", _bin(F.col("score"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.abs(F.avg("score") - F.avg("truth")).alias("gap"),
        F.min("truth").alias("low"),
        F.max("truth").alias("high"),
    )
    weighted = F.sum(F.when(F.col("bin") > 0, F.col("gap") * F.col("n")).otherwise(0.0)) / F.sum("n")
    return per_bin.groupBy("head").agg(
        F.when(F.min("low") != F.max("high"), weighted).otherwise(0.0).alias("ece")
    )


# -- tags -------------------------------------------------------------------------------------------------------


def tag_pairs(tags: DataFrame) -> DataFrame:
    """(pred, truth) counts over all positions that are not ignored. Positions without a tag on either side, nearly all, are
    counted in their row; only the others become rows."""
    zipped = F.arrays_zip(F.col("pred").alias("pred"), F.col("truth").alias("truth"))
    kept = F.filter(zipped, lambda z: z["truth"] != IGNORE_ID)

    def counted(z: Column) -> Column:
        telling = F.filter(z, lambda x: F.coalesce((x["pred"] != 0) | (x["truth"] != 0), F.lit(True)))
        outside = F.struct(F.lit(0).alias("pred"), F.lit(0).alias("truth"), (F.size(z) - F.size(telling)).cast("long").alias("n"))
        others = F.transform(telling, lambda x: F.struct(x["pred"].cast("int").alias("pred"), x["truth"].cast("int").alias("truth"), F.lit(1).cast("long").alias("n")))
        return F.concat(F.array(outside), others)

    flat = tags.select(F.inline_outer(let(kept, counted))).filter("n > 0")
    return flat.groupBy("pred", "truth").agg(F.sum("n").alias("n"))


def token_metrics(tags: DataFrame, n_classes: int = 21) -> DataFrame:
    """One row: accuracy, macro F1 over all tags but O, weighted precision / recall / F1, and the same over positions
    whose truth is not O. Works on the (pred, truth) count matrix, at most n_classes squared rows."""
    pairs = tag_pairs(tags)
    per_tag = (
        pairs.select(F.explode(F.array_distinct(F.array("pred", "truth"))).alias("tag"), "pred", "truth", "n")
        .groupBy("tag")
        .agg(
            F.sum(F.when((F.col("pred") == F.col("tag")) & (F.col("truth") == F.col("tag")), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("pred") == F.col("tag"), F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(F.col("truth") == F.col("tag"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when((F.col("pred") == F.col("tag")) & (F.col("truth") > 0), F.col("n")).otherwise(0)).alias("predicted_pii"),
        )
    )
    tp, support = F.col("tp"), F.col("support")
    scored = per_tag.withColumns({"p": _ratio(tp, F.col("predicted")), "r": _ratio(tp, support), "pp": _ratio(tp, F.col("predicted_pii"))})
    scored = scored.withColumns({"f": _f1(F.col("p"), F.col("r")), "pf": _f1(F.col("pp"), F.col("r"))})
    entity = F.col("tag") > 0
    weighted = lambda c, on: _ratio(F.sum(F.when(on, F.col(c) * support).otherwise(0.0)), F.sum(F.when(on, support).otherwise(0)))
    every = F.lit(True)
    return scored.agg(
        _ratio(F.sum("tp"), F.sum("support")).alias("span_accuracy"),
        (F.sum(F.when(entity, F.col("f")).otherwise(0.0)) / (n_classes - 1)).alias("span_f1_macro"),
        weighted("p", every).alias("token_precision"), weighted("r", every).alias("token_recall"), weighted("f", every).alias("token_f1"),
        weighted("pp", entity).alias("pii_precision"), weighted("r", entity).alias("pii_recall"), weighted("pf", entity).alias("pii_f1"),
    )


def entity_f1(tags: DataFrame, vocabulary: str = "training") -> DataFrame:
    """One row: entity counts, precision, recall and F1, entities compared within their message (no shuffle)."""
    kept = tags.select(
        F.transform(F.filter(F.arrays_zip("pred", "truth"), lambda z: z["truth"] != IGNORE_ID), lambda z: z["pred"]).alias("pred"),
        F.filter("truth", lambda t: t != IGNORE_ID).alias("truth"),
    )
    found = kept.select(tag_entities("pred", vocabulary).alias("p"), tag_entities("truth", vocabulary).alias("t"))
    counts = found.agg(
        F.coalesce(F.sum(F.size(F.array_intersect("p", "t"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.size("p")), F.lit(0)).alias("predicted"),
        F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("actual"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("actual"))
    nothing = (F.col("predicted") == 0) & (F.col("actual") == 0)
    return counts.select(
        "*", precision.alias("precision"), recall.alias("recall"),
        F.when(nothing, 1.0).otherwise(_f1(precision, recall)).alias("entity_f1"),
    )


def exact_match(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """One row over two array columns: rows equal where truth is not ignored, mean share of right positions, and
    outputs equal as a whole."""
    valid = F.filter(F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("t")), lambda z: z["t"] != IGNORE_ID)
    counted = df.select(
        F.size(valid).alias("n"), F.size(F.filter(valid, lambda z: z["p"] == z["t"])).alias("ok"), (F.col(pred) == F.col(truth)).alias("same")
    )
    return counted.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("same").alias("equal_outputs"),
        F.count_if((F.col("n") > 0) & (F.col("ok") == F.col("n"))).alias("exact_sequences"),
        F.avg(F.when(F.col("n") > 0, F.col("ok") / F.col("n"))).alias("mean_accuracy"),
    )


def all_heads_correct(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: share of messages with every head right."""
    right = (F.col("score") > threshold) == (F.col("truth") == 1)
    per_message = scores.groupBy("msg_id").agg(F.bool_and(right).alias("ok"))
    return per_message.agg(F.count(F.lit(1)).alias("messages"), F.avg(F.col("ok").cast("double")).alias("share"))


# -- decisions --------------------------------------------------------------------------------------------------

SHIFTS = (-5, -3, 3, 5)
MIN_SHIFTED_LENGTH = 10


def decision_stability(df: DataFrame, score, shifts=SHIFTS) -> DataFrame:
    """Share of (message, shift) pairs whose four decisions equal those of the whole text.

    ``score(column)`` gives the four heads of a text. A negative shift cuts characters from the start, a positive one
    from the end; shorter results than 11 characters do not count.
    """
    cut = lambda k: F.substring(F.col("body"), -k + 1, 2**31 - 1) if k < 0 else F.left("body", F.length("body") - k)
    texts = F.array(F.col("body"), *[F.when(F.length("body") - abs(k) > MIN_SHIFTED_LENGTH, cut(k)) for k in shifts])

    def decided(text: Column) -> Column:
        return F.when(text.isNotNull(), let(score(text), lambda scores: F.array(*[scores[h] > 0.5 for h in HEADS])))

    # One lambda over the five texts keeps the generated code small.
    every = df.select(F.transform(texts, decided).alias("d"))
    flat = every.select(F.posexplode_outer("d").alias("i", "one"), F.get("d", F.lit(0)).alias("base")).filter(
        "i > 0 and one is not null"
    ).select((F.col("one") == F.col("base")).alias("same"))
    return flat.agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.coalesce(F.avg(F.col("same").cast("double")), F.lit(0.0)).alias("decision_stability"),
    )


def pattern_stability(df: DataFrame, shifts=SHIFTS, body: str = "body") -> DataFrame:
    """``decision_stability`` of the pattern scores, all four heads from the text, in one pass over each text."""
    scores = L.pattern_scores_after_cuts(F.col(body), shifts)
    decided = lambda s: F.array(*[s[h] > 0.5 for h in HEADS])
    kept = F.array(*[F.length(body) - abs(k) > MIN_SHIFTED_LENGTH for k in shifts])
    rows = df.select(F.transform(scores, decided).alias("d"), kept.alias("kept"))
    same = F.transform("kept", lambda k, i: F.when(k, F.get("d", i + 1) == F.get("d", F.lit(0))))
    counted = rows.select(same.alias("same")).select(F.explode_outer("same").alias("same")).filter("same is not null")
    return counted.agg(
        F.count(F.lit(1)).alias("comparisons"),
        F.coalesce(F.avg(F.col("same").cast("double")), F.lit(0.0)).alias("decision_stability"),
    )


def decision_distribution(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Per decision: count, percent and mean scores."""
    decided = df.select(L.decide(F.col(scores))["decision"].alias("decision"), F.col(scores))
    counted = decided.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"{scores}.{h}").alias(f"mean_{h}") for h in HEADS]
    )
    total = decided.agg(F.count(F.lit(1)))
    return counted.withColumn("percent", F.col("n") / total.scalar() * 100)


def score_spread(df: DataFrame, scores: str = "scores") -> DataFrame:
    """Per head: range, deviation, whether it varies at all, and whether it varies most."""
    stats = df.agg(
        *[
            F.struct((F.max(f"{scores}.{h}") - F.min(f"{scores}.{h}")).alias("range"), F.stddev_pop(f"{scores}.{h}").alias("std")).alias(h)
            for h in HEADS
        ]
    )
    best = F.greatest(*[F.col(f"{h}.std") for h in HEADS])
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("head"), F.col(f"{h}.range").alias("range"), F.col(f"{h}.std").alias("std"),
                (F.col(f"{h}.range") > 1e-6).alias("active"), (F.col(f"{h}.std") == best).alias("most_discriminative"),
            )
            for h in HEADS
        ]
    )
    return stats.select(F.inline(rows))


def calibration_report(df: DataFrame, risk: str = "risk", expected: str = "expected") -> DataFrame:
    """One row: MAE overall and by band of expected risk, correlation, decision accuracy, range, deviation."""
    error = F.abs(F.col(risk) - F.col(expected))
    band = lambda c: F.avg(F.when(c, error))
    e = F.col(expected)
    measures = [
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("mae"),
        band(e > 0.7).alias("mae_high"), band(e.between(0.3, 0.7)).alias("mae_medium"), band(e < 0.3).alias("mae_low"),
        safe_corr(F.col(risk), e).alias("correlation"),
        (F.max(risk) - F.min(risk)).alias("risk_range"), F.stddev_pop(risk).alias("risk_std"),
    ]
    if {"decision", "expected_decision"} <= set(df.columns):
        measures.append(F.avg((F.col("decision") == F.col("expected_decision")).cast("double")).alias("decision_accuracy"))
    return df.agg(*measures)


def risk_ranking(df: DataFrame, key: str, risk: str = "risk", expected: str = "expected") -> DataFrame:
    """Rank of every row by risk and by expected risk, highest first."""
    from riskweave.operators.positions import ordered_index

    by_risk = ordered_index(df.select(key, risk, expected), [F.desc(risk), F.col(key)], "actual_rank")
    return ordered_index(by_risk, [F.desc(expected), F.col(key)], "expected_rank")


def score_rows(df: DataFrame, scores: str = "scores", keys=("msg_id",)) -> DataFrame:
    """(keys, head, score) rows of a score struct."""
    wide = df.select(*keys, *[F.col(f"{scores}.{h}").alias(h) for h in HEADS])
    return wide.unpivot(list(keys), HEADS, "head", "score")

