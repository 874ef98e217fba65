"""Per-pattern models blended with the pooled model on the logit scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelattice.functions.scalars import logit
from sitelattice.operators.blockmetrics import linear_metrics
from sitelattice.operators.matrix import column_stats
from sitelattice.operators.memberships import Bank, fit_bank
from sitelattice.operators.metrics import score_metrics
from sitelattice.operators.ordered import first_by_hash
from sitelattice.session import materialise

LAMBDAS = [i / 8 for i in range(9)]
MIN_SUPPORT = 30
INNER = 0.35
LOCAL_MIN_FIT, LOCAL_MIN_VAL = 8, 4


def _design(df: DataFrame, xs: list[str], fill: list[float]) -> tuple[DataFrame, list[str]]:
    zs = [f"z{j}" for j in range(2 * len(xs))]
    cols = [F.coalesce(F.col(x), F.lit(fill[j])).alias(f"z{j}") for j, x in enumerate(xs)]
    cols += [F.col(x).isNotNull().cast("double").alias(f"z{len(xs) + j}") for j, x in enumerate(xs)]
    return df.select("*", *cols), zs


def fit_blend(train: DataFrame, test: DataFrame, group: str, y: str, xs: list[str], ids: list[str],
              seed="blend") -> tuple[DataFrame, DataFrame]:
    """Scored test rows and the blend weight of each group.

    Rows: ids, group, y, z_pool, z_local (NULL where the group cannot be fitted) and lam.
    The pooled model, every group's model and both inner-fit versions share the scans; the
    inner split is one for all groups.
    """
    fill = column_stats(train, [], xs).orderBy("var").toPandas()["mean"].fillna(0.0).astype(float).tolist()
    tr, zs = _design(train, xs, fill)
    te, _ = _design(test, xs, fill)
    r = first_by_hash(tr.select(*ids, group, y, *zs), [], ids, seed, INNER, "inner")
    tr = materialise(r.withColumn("inner", F.col("inner").cast("int")).withColumn(
        "__key", F.concat_ws("~", group, F.col("inner").cast("string"))).drop(*ids))
    sizes = tr.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"), F.sum("inner").alias("n_val"),
        F.sum(F.when(F.col("inner") == 0, F.col(y)).otherwise(0)).alias("fit_pos")).toPandas()
    models = {"pool": [], "pool~inner": []}
    for g in sizes[group]:
        models["pool"] += [f"{g}~0", f"{g}~1"]
        models["pool~inner"].append(f"{g}~0")
    fit_ok = (sizes["n"] >= MIN_SUPPORT) & (sizes["pos"] > 0) & (sizes["pos"] < sizes["n"])
    n_fit = sizes["n"] - sizes["n_val"]
    inner_ok = fit_ok & (sizes["n_val"] >= LOCAL_MIN_VAL) & (n_fit >= LOCAL_MIN_FIT) & (
        sizes["fit_pos"] > 0) & (sizes["fit_pos"] < n_fit)
    for g in sizes[group][fit_ok]:
        models[f"local~{g}"] = [f"{g}~0", f"{g}~1"]
    for g in sizes[group][inner_ok]:
        models[f"inner~{g}"] = [f"{g}~0"]
    bank = fit_bank(tr, "__key", y, zs, models)
    v = _scored(tr.where("inner = 1"), [group, y], group, zs, bank, "pool~inner",
                {g: f"inner~{g}" for g in sizes[group][inner_ok]}).where("z_local IS NOT NULL")
    tried = sizes[[group]][inner_ok].merge(pd.DataFrame({"lam": LAMBDAS}), how="cross")
    blends = tr.sparkSession.createDataFrame(tried, f"{group} string, lam double").select(
        group, "lam", F.lit(0.0).alias("raw_b"), F.array(1 - F.col("lam"), "lam").alias("__raw"), F.array(F.lit(0.0), F.lit(0.0)).alias("__mu"))
    # of equal average precisions the smaller lambda wins, whatever order the sums were added in
    s = linear_metrics(materialise(v), blends, [group, "lam"], group, y, ["z_local", "z_pool"], "raw")
    lam = s.where("auprc IS NOT NULL").groupBy(group).agg(
        F.max(F.struct(F.round("auprc", 12), (-F.col("lam")).alias("l"))).alias("b")).select(group, (-F.col("b.l")).alias("lam"))
    lam = materialise(lam)
    scored = _scored(te, [*ids, group, y], group, zs, bank, "pool", {g: f"local~{g}" for g in sizes[group][fit_ok]})
    return scored.join(lam, group, "left"), lam


def _scored(rows: DataFrame, carry: list[str], group: str, zs: list[str], bank: Bank, pool: str, local: dict[str, str]) -> DataFrame:
    """(carry, z_pool, z_local): each row under the pooled model and, where its group has one, under the group's, in one scan."""
    at = {n: i for i, n in enumerate(bank.names)}
    w, b = bank.raw()
    own = {g: at[m] for g, m in local.items() if bank.ok[at[m]]}
    pooled = at[pool] if bank.ok[at[pool]] else None
    shared = rows.sparkSession.sparkContext.broadcast((w, b, own, pooled))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in carry) + ", __pp double, __pl double"

    def scan(batches):
        w, b, own, pooled = shared.value
        for pdf in batches:
            x = pdf[zs].to_numpy(dtype=float)
            m = pdf[group].map(own).to_numpy(dtype=float)
            has = ~np.isnan(m)
            k = m[has].astype(int)
            zl = np.full(len(x), np.nan)
            zl[has] = b[k] + np.einsum("ij,ij->i", x[has], w[k])
            zp = np.full(len(x), np.nan) if pooled is None else b[pooled] + x @ w[pooled]
            yield pdf[carry].assign(**{n: 1 / (1 + np.exp(-np.clip(z, -35, 35))) for n, z in (("__pp", zp), ("__pl", zl))})

    p = rows.select(*dict.fromkeys([*carry, group]), *zs).mapInPandas(scan, schema)
    z = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c), logit(F.col(c)))
    return p.select(*carry, z("__pp").alias("z_pool"), z("__pl").alias("z_local"))


def arm_score(name: str) -> Column:
    """Score of a row of ``fit_blend`` by pooled, local or blend_cv."""
    zp, zl, lam = F.col("z_pool"), F.col("z_local"), F.col("lam")
    z = {"pooled": zp, "local": F.coalesce(zl, zp),
         "blend_cv": F.coalesce((1 - lam) * zl + lam * zp, zp)}[name]
    return 1 / (1 + F.exp(-z))


def arm(scored: DataFrame, name: str) -> DataFrame:
    """Add ``p`` for pooled, local or blend_cv."""
    return scored.withColumn("p", arm_score(name))


def blend_oracle(scored: DataFrame, group: str, y: str, passes: int = 3) -> DataFrame:
    """Weights by coordinate ascent on the whole test score: a ceiling, never below pooled.

    One job per group and pass scores all candidate weights of that group together.
    """
    rows = materialise(scored.where("z_pool IS NOT NULL"))
    groups = sorted(r[0] for r in rows.where("z_local IS NOT NULL").select(group).distinct().collect())
    spark = rows.sparkSession
    lam = {g: 1.0 for g in groups}
    best = score_metrics(arm(rows, "pooled"), [], y).first()["auprc"]
    schema = f"{group} string, cur double"
    for _ in range(passes):
        moved = False
        for g in groups:
            now = spark.createDataFrame(list(lam.items()), schema)
            j = rows.join(F.broadcast(now), group, "left").withColumn(  # one row per pattern
                "cand", F.explode(F.array(*[F.lit(x) for x in LAMBDAS])))
            w = F.when(F.col(group) == g, F.col("cand")).otherwise(F.coalesce("cur", F.lit(1.0)))
            z = F.when(F.col("z_local").isNull(), F.col("z_pool")).otherwise(
                (1 - w) * F.col("z_local") + w * F.col("z_pool"))
            s = score_metrics(j.select("cand", y, (1 / (1 + F.exp(-z))).alias("p")), ["cand"], y).orderBy("cand").collect()
            for r in s:
                if r["auprc"] is not None and r["auprc"] > best + 1e-12:
                    best, lam[g], moved = r["auprc"], r["cand"], True
        if not moved:
            break
    now = spark.createDataFrame(list(lam.items()), f"{group} string, lam double") if lam else None
    out = rows.drop("lam")
    out = out.join(F.broadcast(now), group, "left") if now is not None else out.withColumn("lam", F.lit(None).cast("double"))
    return arm(out, "blend_cv")
