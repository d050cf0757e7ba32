import numpy as np
from pyspark.sql import functions as F

from riskweave.operators import stratification as St
from riskweave.operators.splits import domain_leakage

RATIOS = {"train": 0.7, "val": 0.15, "test": 0.15}


def off(done, strata):
    """Largest distance from the target per value."""
    shares = {(r["value"], r["split"]): r["share"] for r in St.stratum_shares(done, strata).collect()}
    return {v: max(abs(shares.get((v, s), 0.0) - x) for s, x in RATIOS.items()) for v in {v for v, _ in shares}}


def rows(spark, n, domains, skew=False):
    rng = np.random.default_rng(1)
    home = rng.integers(0, domains, n)
    if skew:
        home[: n // 3] = 0  # one domain with a third of all rows
    role = np.where(rng.random(n) < 0.02, "rare", np.where(home % 3 == 0, "legal", "sales"))  # roles follow domains
    spans = [[t for t in ("EMAIL", "PAN", "SSN") if rng.random() < {"EMAIL": 0.6, "PAN": 0.1, "SSN": 0.03}[t]] for _ in range(n)]
    data = [(i, f"d{home[i]}.com", str(role[i]), ["work", "home"][int(home[i]) % 2], spans[i]) for i in range(n)]
    return spark.createDataFrame(data, "msg_id long, domain string, role string, kind string, span_types array<string>")


STRATA = ["role", "kind", "span_types"]


def test_shares_and_disjoint_domains(spark):
    for n, domains in ((6000, 3000), (4000, 150)):  # all in buckets, and all by name
        done = St.split_by_strata(rows(spark, n, domains), "domain", STRATA)
        assert done.count() == n and done.filter("split is null").count() == 0
        assert domain_leakage(done, "domain").count() == 0
        assert max(off(done, STRATA).values()) <= 0.02
        assert done.columns == ["msg_id", "domain", "role", "kind", "span_types", "split"]


def test_a_domain_with_a_third(spark):
    done = St.split_by_strata(rows(spark, 6000, 800, skew=True), "domain", STRATA)
    assert domain_leakage(done, "domain").count() == 0
    assert max(off(done, STRATA).values()) <= 0.02  # it goes to train, the others even out


def test_odd_rows(spark):
    data = [(1, None, None, None), (2, None, "a", ["x", "x", None]), (2, None, "a", ["x"]), (None, "d", None, []), (5, "d", "a", None)]
    df = spark.createDataFrame(data, "msg_id long, domain string, role string, tags array<string>").withColumn("_n", F.lit("clash"))
    done = St.split_by_strata(df, "domain", ["role", "tags"])
    assert done.count() == 5 and done.filter("split is null").count() == 0
    assert done.filter("domain = 'd'").select("split").distinct().count() == 1
    assert {r["value"]: r["t"] for r in St.stratum_shares(done, ["role", "tags"]).groupBy("value").agg(F.sum("n").alias("t")).collect()} == {"all=": 5, "role=a": 3, "tags=x": 2}
    assert St.split_by_strata(df.limit(0), "domain", ["role"]).count() == 0


def test_placing_is_near_the_best_for_few_units():
    rng = np.random.default_rng(0)
    ratios = np.array([0.7, 0.15, 0.15])
    for _ in range(15):
        counts = rng.integers(0, 20, (7, 3)).astype(float)
        total = counts.sum(axis=0)

        def cost(split, counts=counts, total=total):
            return sum((((counts[split == k].sum(axis=0) - ratios[k] * total) / total) ** 2).sum() for k in range(3))

        best = min(cost(np.array(np.unravel_index(i, (3,) * 7))) for i in range(3**7))
        assert cost(St.place_units(counts, ratios)) <= best + 0.03
