"""The tokens that clip_cov and kl_cov pick, against plain Python, and the same for any partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import losses as L

RND = random.Random(4)
ROWS = [(i, *([RND.gauss(0, 1) for _ in range(9)] for _ in range(3)), [RND.randint(0, 1) for _ in range(9)]) for i in range(40)]
NAMES = "row_id long, log_prob array<double>, old_log_prob array<double>, advantages array<double>, mask array<int>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, NAMES)


def covariances():
    live = [(i, k, lp[k], old[k], a[k]) for i, lp, old, a, m in ROWS for k in range(9) if m[k]]
    ma, ml = sum(x[4] for x in live) / len(live), sum(x[2] for x in live) / len(live)
    return [((a - ma) * (lp - ml), i, k) for i, k, lp, old, a in live], live


def picked(df):
    return sorted((r.row_id, i) for r in df.select("row_id", "_pick").collect() for i in r["_pick"])


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_kl_cov_takes_the_largest_covariances(spark, rows, parts):
    cov, live = covariances()
    share = 0.1
    want = sorted((i, k) for _, i, k in sorted(cov, key=lambda x: (-x[0], x[1], x[2]))[: int(len(live) * share)])
    one = L.covariance(rows.repartition(parts, "row_id"), 0.0)
    score = lambda t: (t["a"] - F.col("_ma")) * (t["lp"] - F.col("_ml"))
    assert picked(L.chosen_tokens(one, lambda t: F.lit(True), score, share, (F.desc("s"), "row_id", "i"))) == want


def test_clip_cov_is_the_same_for_any_partitioning(spark, rows):
    got = []
    for parts in (4, 32):
        out = L.clip_cov(rows.repartition(parts, "row_id"), share=0.05, lb=0.0, ub=9.0, seed=3).first()
        got.append({k: round(v, 9) for k, v in out.asDict().items()})
    assert got[0] == got[1] and got[0]["pg_clipfrac"] > 0
