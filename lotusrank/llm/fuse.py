"""One order from several scores on different scales: first principal component of rank-transformed scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotusrank.functions.scale import cut, with_group_offsets


def rank_transform(df: DataFrame, group: str, item: str, scores: list[str]) -> DataFrame:
    """Replaces every score by its mean rank inside its group divided by (ranked rows + 1), so in (0, 1).

    Rows without a usable score (null, NaN) get 0.5, the middle; a constant group is 0.5 throughout. Equal values of all
    scores are counted together before anything is sorted, and the sort is spread over ranges of (group, score, value).
    """
    value = [F.when(~F.isnan(c), F.col(c)) for c in scores]
    long = df.select(group, F.explode(F.array(*[F.struct(F.lit(i).alias("no"), v.alias("v")) for i, v in enumerate(value)])).alias("s"))
    v = long.filter("s.v is not null").groupBy(group, F.col("s.no").alias("__no"), F.col("s.v").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    placed = with_group_offsets(v, [group, "__no"], [F.col("__v")], "__n", "__before")
    sizes = placed.groupBy(group, "__no").agg(F.sum("__n").alias("__size"))
    ranked = cut(placed.join(sizes, [group, "__no"]).select(group, "__no", "__v", ((F.col("__before") + (F.col("__n") + 1) / 2) / (F.col("__size") + 1)).alias("__r")))
    for i, c in enumerate(scores):
        one = ranked.filter(F.col("__no") == i).select(F.col(group).alias("__g"), F.col("__v"), F.lit(0).alias("__spare"), "__r")
        # rows without a score meet nothing; their own key keeps them from meeting in one task
        df = df.withColumn("__k", value[i]).withColumn("__s", F.when(F.col("__k").isNull(), 1 + F.pmod(F.xxhash64(item), F.lit(1000)).cast("int")).otherwise(0))
        df = df.join(one, (F.col(group) == F.col("__g")) & (F.col("__k") == F.col("__v")) & (F.col("__s") == F.col("__spare")), "left")
        df = df.withColumn(c, F.coalesce("__r", F.lit(0.5))).drop("__g", "__v", "__spare", "__r", "__k", "__s")
    return df


def first_component(corr: np.ndarray, directions: list[int]) -> np.ndarray:
    """Loadings of the first principal component, for scores as they are.

    The scores are turned to their declared directions (+1: more is better), and the component as a whole to the side on
    which most of its weight agrees with them; a score that runs against the others then counts against its direction.
    Where that leaves the side open (two opposed scores) or the first eigenvalue is not single (uncorrelated scores), all
    weights are equal. Scores without any variance weigh nothing.
    """
    live = np.isfinite(np.diag(corr))
    turn = np.sign(directions)
    m = np.where(np.isfinite(corr), corr, 0.0) * np.outer(turn, turn)
    out = np.zeros(len(m))
    k = np.flatnonzero(live)
    if len(k):
        val, vec = np.linalg.eigh(m[np.ix_(k, k)])
        first, side = vec[:, -1], vec[:, -1].sum()
        clear = len(k) == 1 or val[-1] - val[-2] > 1e-9 and abs(side) > 1e-9
        out[k] = first * np.sign(side) if clear else 1 / np.sqrt(len(k))
    return out * turn


def fuse(df: DataFrame, group: str, item: str, scores: dict[str, int]) -> DataFrame:
    """(group, item, projection, position): one order of the items of every group in which all scores count.

    `scores` maps each score column to its direction. The correlation matrix of the rank-transformed scores is one
    distributed aggregate over all rows that have every score; only its k * k numbers reach the driver. Rows with a
    null group or item are in no pool; repeated rows count once (of different rows of one item the highest scores
    count); ties in the projection (9 decimals) go to the smaller item; empty input gives no row.
    """
    num = [F.col(c).cast("double").alias(f"__s{i}") for i, c in enumerate(scores)]
    d = df.select(F.col(group).alias("__grp"), F.col(item).alias("__item"), *num).filter(F.col("__grp").isNotNull() & F.col("__item").isNotNull())
    s, k = [f"__s{i}" for i in range(len(scores))], len(scores)
    d = d.groupBy("__grp", "__item").agg(*[F.max(F.when(~F.isnan(c), F.col(c))).alias(c) for c in s])
    d = d.withColumn("__full", F.expr(" and ".join(f"{c} is not null" for c in s)))
    d = cut(rank_transform(d, "__grp", "__item", s))
    both = [F.corr(F.when(F.col("__full"), F.col(s[i])), F.when(F.col("__full"), F.col(s[j]))).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]
    got = d.agg(*both, *[F.avg(c).alias(f"m{i}") for i, c in enumerate(s)], *[F.stddev_pop(c).alias(f"d{i}") for i, c in enumerate(s)]).first()
    corr = np.full((k, k), np.nan)
    for i in range(k):
        for j in range(i + 1):
            x = got[f"c{i}_{j}"]
            corr[i, j] = corr[j, i] = np.nan if x is None else x
        if got[f"d{i}"]:
            corr[i, i] = 1.0
    load = first_component(corr, list(scores.values()))
    proj = F.lit(0.0)
    for i in range(k):
        if got[f"d{i}"]:
            proj = proj + F.lit(float(load[i])) * (F.col(s[i]) - F.lit(got[f"m{i}"])) / F.lit(got[f"d{i}"])
    d = d.select("__grp", "__item", (F.round(proj, 9) + 0.0).alias("projection"), F.lit(1).alias("__one"))
    d = with_group_offsets(d, ["__grp"], [F.col("projection").desc(), F.col("__item").asc()], "__one", "__before")
    return d.select(F.col("__grp").alias(group), F.col("__item").alias(item), "projection", (F.col("__before") + 1).cast("long").alias("position"))
