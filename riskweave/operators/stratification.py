"""Splits that keep whole domains together and give every stratum its share.

1. Rows are counted per (domain, stratum value), partial before their shuffle. A row may have several values (its span
   types), and several strata at once (role, domain type, span types).
2. Domains that hold a noticeable part (1 / ``LARGE``) of any value are few: each value has fewer than ``LARGE`` of them.
   They stay units of their own. All other domains are summed into ``BUCKETS`` units by hash. So the table of units and
   values is bounded by the number of values, whatever the number of rows and domains, and fits the driver.
3. Units are placed one after another, the largest first, where the shares that they would fill are emptiest (squared
   distance from the targets in units of two points, summed over all values); then units move, or change places with one of ``SWAPS`` others, as
   long as that brings the table nearer.
4. The placed units go back to the rows as a lookup of the large domains and of the buckets: no row is shuffled.

Domains are disjoint over splits by construction. A share can be off by as much as the domains force: a domain with a
third of a value's rows can't be halved. Rows without a domain can't leak, so each goes by its own key. Values that are
null belong to no stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from riskweave.fixed import corpus

LARGE = 200
BUCKETS = 2_048
SWAPS = 1_000
POINTS = 0.02
MOST_VALUES = 1_000
_ALL = "all"  # the stratum of every row, so that the splits themselves have their sizes


def _values(df: DataFrame, strata: Sequence[str]) -> Column:
    """Every stratum value of a row, named by its stratum, once."""

    def named(name: str) -> Column:
        many = F.col(name) if isinstance(df.schema[name].dataType, ArrayType) else F.array(name)
        text = F.transform(many, lambda v: F.concat(F.lit(f"{name}="), v.cast("string")))
        return F.coalesce(F.filter(text, lambda v: v.isNotNull()), F.array())

    return F.array_distinct(F.concat(F.array(F.lit(f"{_ALL}=")), *[named(s) for s in strata]))


def _ratios(splits: dict[str, float] | None) -> dict[str, float]:
    if splits:
        return splits
    train, val = corpus.SPLIT_RATIOS["train"], corpus.SPLIT_RATIOS["val"]
    return {"train": train, "val": val, "test": 1 - train - val}


def place_units(counts: np.ndarray, ratios: Sequence[float], passes: int = 20) -> np.ndarray:
    """Split number of every unit (rows of ``counts``: units x values)."""
    total = counts.sum(axis=0)
    unit = POINTS * total + 1  # two points and a row are as bad for every value, however rare
    share = counts / unit
    target = np.outer(np.asarray(ratios), total / unit)
    filled = np.zeros_like(target)
    split = np.zeros(len(counts), np.int64)
    for u in np.lexsort((np.arange(len(counts)), -share.max(axis=1, initial=0))):
        split[u] = int(((filled - target) @ share[u]).argmin())  # least growth of the squared distance
        filled[split[u]] += share[u]
    for _ in range(passes):
        moved = False
        for u in range(len(counts)):
            here, own = split[u], share[u]
            over = filled - target
            gain = over @ own + own @ own / 2
            gain[here] = (over[here] - own) @ own + own @ own / 2
            there = int(gain.argmin())
            if there != here and gain[there] < gain[here] - 1e-12:
                filled[here] -= own
                filled[there] += own
                split[u], moved = there, True
                continue
            some = np.arange(max(0, u - SWAPS // 2), min(len(counts), u + SWAPS // 2))
            some = some[split[some] != here]
            change = share[some] - own
            gain = ((over[here] - over[split[some]]) * change).sum(axis=1) + (change**2).sum(axis=1)
            best = int(gain.argmin()) if len(some) else 0
            if len(some) and gain[best] < -1e-12:
                other, there = some[best], split[some[best]]
                filled[here] += change[best]
                filled[there] -= change[best]
                split[u], split[other], moved = there, here, True
        if not moved:
            break
    return split


def split_by_strata(
    df: DataFrame, domain: str, strata: Sequence[str], key: str = "msg_id", splits: dict[str, float] | None = None, out: str = "split"
) -> DataFrame:
    """Adds the split of every row: whole domains, each value of ``strata`` (columns, or arrays of values) in its shares."""
    ratios = _ratios(splits)
    bucket = F.pmod(F.xxhash64(F.lit(7), F.coalesce(F.col(domain).cast("string"), F.concat(F.lit("\x00"), F.col(key).cast("string")))), F.lit(BUCKETS)).cast("int")
    name = F.col(domain).cast("string")
    table = (
        df.select(name.alias("_d"), bucket.alias("_b"), F.explode(_values(df, strata)).alias("_v"))
        .groupBy("_d", "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = {r["_v"]: r["t"] for r in table.groupBy("_v").agg(F.sum("_n").alias("t")).limit(MOST_VALUES + 1).collect()}
    if len(totals) > MOST_VALUES:
        raise ValueError(f"over {MOST_VALUES} stratum values: stratify by fewer or coarser ones")
    if not totals:
        return df.withColumn(out, F.lit(None).cast("string"))
    total_of = F.create_map(*[x for v, t in totals.items() for x in (F.lit(v), F.lit(t))])
    large = table.filter(F.col("_d").isNotNull() & (F.col("_n") * LARGE > total_of[F.col("_v")])).select("_d").distinct()
    names = sorted(r["_d"] for r in large.collect())  # fewer than LARGE a value
    big = df.sparkSession.createDataFrame([(d,) for d in names], "_d string")
    units = table.join(F.broadcast(big.withColumn("_big", F.lit(True))), "_d", "left").groupBy(
        F.when(F.col("_big"), F.col("_d")).alias("_d"), F.when(F.col("_big").isNull(), F.col("_b")).alias("_b"), "_v"
    ).agg(F.sum("_n").alias("_n"))
    rows = units.collect()  # (large domains + buckets) x values
    order = {u: i for i, u in enumerate(sorted({(r["_d"] or "", -1 if r["_b"] is None else r["_b"]) for r in rows}))}
    column = {v: i for i, v in enumerate(sorted(totals))}
    counts = np.zeros((len(order), len(column)))
    for r in rows:
        counts[order[(r["_d"] or "", -1 if r["_b"] is None else r["_b"])], column[r["_v"]]] = r["_n"]
    labels = list(ratios)
    placed = [(d if b < 0 else None, b, labels[s]) for (d, b), s in zip(order, place_units(counts, list(ratios.values())), strict=True)]
    spark = df.sparkSession
    by_name = spark.createDataFrame([(d, s) for d, b, s in placed if b < 0], "_d string, _s string")
    by_bucket = spark.createDataFrame([(b, s) for _, b, s in placed if b >= 0], "_b int, _s2 string")
    keyed = df.drop(out).withColumns({"_d": name, "_b": bucket})
    found = keyed.join(F.broadcast(by_name), "_d", "left").join(F.broadcast(by_bucket), "_b", "left")
    return found.withColumn(out, F.coalesce("_s", "_s2")).drop("_d", "_b", "_s", "_s2")


def stratum_shares(df: DataFrame, strata: Sequence[str], split: str = "split") -> DataFrame:
    """value ('stratum=value'), split, n, share of the value's rows."""
    counted = df.select(F.explode(_values(df, strata)).alias("value"), split).groupBy("value", split).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("value").agg(F.sum("n").alias("t"))
    return counted.join(totals, "value").select("value", split, "n", (F.col("n") / F.col("t")).alias("share"))
