"""Pattern-conditional models: submodels, hierarchical shrinkage, cover prediction, fusion.

``theta``: pattern, var, value with var = -1 for the intercept, in the standardised units of
one scaler shared by all patterns. Pattern tables come from ``operators.patterns``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.operators import newton as N
from sitelattice.operators.matrix import column_stats
from sitelattice.operators.patterns import cover, observed_set
from sitelattice.session import ensure_checkpoint_dir, materialise

INTERCEPT = -1


def pattern_key(xs: list[str]):
    """Text key of a row's exact pattern."""
    return F.concat_ws(",", observed_set(xs).cast("array<string>"))


def observed_scaler(df: DataFrame, xs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population sd over observed cells, one pair per column."""
    s = column_stats(df, [], xs).orderBy("var").toPandas()
    mu = s["mean"].fillna(0.0).to_numpy(float)
    sd = s["sd"].fillna(0.0).to_numpy(float)
    return mu, np.where(sd > 0, sd, 1.0)


def fit_submodels(df: DataFrame, xs: list[str], y: str, realised: DataFrame, fitted: DataFrame,
                  mu: np.ndarray, sd: np.ndarray, c: float = 1.0) -> DataFrame:
    """theta of one logistic per fitted pattern on all rows observing its variables.

    Rows are keyed by exact pattern and add to every fitted pattern they contain, so no row
    is copied. One-class patterns get zeros. Patterns go in batches of bounded state.
    """
    spark, d = df.sparkSession, len(xs)
    tot = cover(fitted, realised, d).join(
        realised.select("pattern", F.col("n").alias("rn"), F.col("pos").alias("rp")), "pattern")
    cls = tot.groupBy("member").agg(F.sum("rn").alias("n"), F.sum("rp").alias("pos")).toPandas()
    table = fitted.select("pattern", "vars").toPandas().merge(
        cls, left_on="pattern", right_on="member").sort_values("pattern").reset_index(drop=True)
    keyed = df.select(pattern_key(xs).alias("__k"), y, *xs)
    out = []
    for b in N.batches(len(table), d):
        part = table.iloc[list(b)].reset_index(drop=True)
        act = np.zeros((len(part), d), bool)
        for i, v in enumerate(part["vars"]):
            act[i, list(v)] = True
        live = ((part["pos"] > 0) & (part["pos"] < part["n"])).to_numpy()
        names = part["pattern"].tolist()
        pairs = cover(fitted.where(F.col("pattern").isin(names)), realised, d).toPandas()
        at = {p: i for i, p in enumerate(names)}
        pairs["m"] = pairs["member"].map(at)
        pairs = pairs[live[pairs["m"].to_numpy(int)]] if len(pairs) else pairs
        groups = pairs.groupby("pattern")["m"].apply(lambda s: np.sort(s.to_numpy(int)))
        row_act = np.zeros((len(groups), d), bool)
        for i, p in enumerate(groups.index):
            if p:
                row_act[i, [int(v) for v in p.split(",")]] = True
        k = len(part)
        design = N.Design(list(groups.index), np.zeros((len(groups), d)), row_act,
                          np.tile(mu, (k, 1)), np.tile(sd, (k, 1)), act, np.full(k, c), list(groups))
        theta = np.zeros((k, d + 1))
        if len(groups):
            theta, _, _ = N.fit(keyed, "__k", y, xs, design)
        g, v = np.nonzero(act)
        out.append(pd.DataFrame({
            "pattern": np.r_[np.array(names, object)[g], np.array(names, object)],
            "var": np.r_[v, np.full(k, INTERCEPT)].astype("int32"),
            "value": np.r_[theta[g, v], theta[:, d]]}))
    schema = "pattern string, var int, value double"
    return spark.createDataFrame(pd.concat(out), schema) if out else spark.createDataFrame([], schema)


def shrink(theta: DataFrame, fitted: DataFrame, edges: DataFrame, kappas: list[float] | None,
           coordinatewise: bool = False) -> DataFrame:
    """theta shrunk toward support-weighted immediate ancestors, at every kappa of a grid.

    Without a grid, theta brings its own ``kappa`` column.

    Patterns are taken by size, smallest first, so parents are already shrunk. A variable no
    parent has keeps the pattern's own value. Each level is written once and read by later
    ones, which keeps the plan of a level short however deep the hierarchy is.
    """
    if kappas and any(k < 0 for k in kappas):
        raise ValueError("kappa must be non-negative")
    spark = theta.sparkSession
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    if kappas is not None:
        theta = theta.withColumn("kappa", F.explode(F.array(*[F.lit(float(k)) for k in kappas])))
    own = materialise(theta.join(fitted.select("pattern", "size", "support"), "pattern"))
    up = edges.join(fitted.select(F.col("pattern").alias("parent"),
                                  F.col("support").cast("double").alias("w")), "parent")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # at most d values
    done = None
    for s in sizes:
        cur = own.where(F.col("size") == s)
        if done is None:
            new = cur
        else:
            par = (up.withColumnRenamed("child", "pattern").join(
                done.select(F.col("pattern").alias("parent"), "kappa", "var",
                            F.col("value").alias("pv")), "parent")
                .groupBy("pattern", "kappa", "var").agg(
                    (F.sum(F.col("w") * F.col("pv")) / F.sum("w")).alias("target"),
                    F.sum("w").alias("mass")))
            j = cur.join(par, ["pattern", "kappa", "var"], "left")
            lam = _lambda(F.col("support"), F.col("kappa"))
            if coordinatewise:
                live = j.where((F.col("var") != INTERCEPT) & (F.col("mass") > 0)).groupBy(
                    "pattern", "kappa").agg(F.avg("mass").alias("mbar"))
                j = j.join(live, ["pattern", "kappa"], "left")
                scaled = _lambda(F.col("support"), F.col("kappa") * F.col("mass") / F.col("mbar"))
                lam = F.when((F.col("var") != INTERCEPT) & F.col("mbar").isNotNull()
                             & (F.col("mass") > 0), scaled).otherwise(lam)
            new = j.withColumn("value", F.when(F.col("target").isNull(), F.col("value")).otherwise(
                lam * F.col("value") + (1 - lam) * F.col("target")))
        new.select("pattern", "var", "kappa", "value", "support").write.parquet(f"{root}/size={s}")
        done = spark.read.parquet(root)
    cols = ["pattern", "var", "kappa", "value", "support"]
    return done.select(*cols)


def _lambda(n, kappa):
    """n / (n + kappa); an infinite kappa gives 0."""
    return F.when(kappa == float("inf"), 0.0).when(n + kappa > 0, n / (n + kappa)).otherwise(0.0)


def toward_global(theta: DataFrame, fitted: DataFrame, kappa: float) -> DataFrame:
    """Every pattern pulled straight to the smallest pattern's model (ties by key)."""
    root = fitted.agg(F.min(F.struct("size", "pattern")).alias("b")).select(
        F.col("b.pattern").alias("pattern"))
    g = theta.join(F.broadcast(root), "pattern").select("var", F.col("value").alias("g"))  # one pattern
    lam = _lambda(F.col("support"), F.lit(float(kappa)))
    j = theta.join(fitted.select("pattern", "support"), "pattern").join(F.broadcast(g), "var", "left")
    return j.select("pattern", "var", "support", F.when(F.col("g").isNull(), F.col("value")).otherwise(
        lam * F.col("value") + (1 - lam) * F.col("g")).alias("value"))


def root_step(theta: DataFrame, fitted: DataFrame, edges: DataFrame, root: dict[int, float],
              kappas: list[float]) -> DataFrame:
    """Per kappa, variables no parent carries are shrunk toward the imputed pooled model."""
    spark = theta.sparkSession
    r = spark.createDataFrame([(int(k), float(v)) for k, v in root.items()], "var int, rv double")
    held = edges.join(theta.select(F.col("pattern").alias("parent"), "var"), "parent").select(
        F.col("child").alias("pattern"), "var").distinct().withColumn("covered", F.lit(True))
    j = (theta.join(fitted.select("pattern", "support"), "pattern")
         .join(held, ["pattern", "var"], "left").join(F.broadcast(r), "var")  # d + 1 rows
         .withColumn("kappa", F.explode(F.array(*[F.lit(float(k)) for k in kappas]))))
    lam = _lambda(F.col("support"), F.col("kappa"))
    return j.select("pattern", "var", "kappa", F.when(F.col("covered").isNotNull(), F.col("value")).otherwise(
        lam * F.col("value") + (1 - lam) * F.col("rv")).alias("value"))


def shrink_rooted(theta: DataFrame, fitted: DataFrame, edges: DataFrame, root: dict[int, float],
                  kappas: list[float]) -> DataFrame:
    """Shrinkage whose hierarchy is rooted at the pooled model, for a grid of kappas."""
    return shrink(root_step(theta, fitted, edges, root, kappas), fitted, edges, None)


def cover_predict(df: DataFrame, xs: list[str], theta: DataFrame, fitted: DataFrame, prior: float,
                  mu: np.ndarray, sd: np.ndarray, weighted: bool = True,
                  root: dict[int, float] | None = None, out: str = "p", fill: np.ndarray | None = None) -> DataFrame:
    """Rows with the (support-weighted) mean of all applicable patterns' predictions.

    Also adds ``n_models``; rows without any applicable pattern get the prior (or the root
    model's score) . Parameters ride along with the scan in bounded batches; a batch adds its
    numerator and denominator to the row, so rows are never shuffled or copied. With
    ``root`` every pattern also carries the root's coefficients on imputed cells.
    """
    d = len(xs)
    spark = df.sparkSession
    table = fitted.select("pattern", "vars", "support").orderBy("pattern").toPandas()
    wide = theta.groupBy("pattern").agg(F.map_from_entries(F.collect_list(F.struct("var", "value"))).alias("t"))
    values = {r["pattern"]: r["t"] for r in wide.collect()}
    fill = mu if fill is None else fill
    base = np.zeros(d + 1)
    if root is not None:
        base[:d] = [root[j] for j in range(d)]
        base[d] = root[INTERCEPT]
    state = [c for c in df.columns]
    cur = df.select("*", F.lit(0.0).alias("__num"), F.lit(0.0).alias("__den"), F.lit(0).alias("__k"))
    schema = cur.schema
    for b in N.batches(len(table), d):
        part = table.iloc[list(b)]
        act = np.zeros((len(part), d), bool)
        th = np.tile(base, (len(part), 1))
        for i, (p, v) in enumerate(zip(part["pattern"], part["vars"])):
            act[i, list(v)] = True
            for var, val in values[p].items():
                th[i, d if var == INTERCEPT else var] = val
        sup = part["support"].to_numpy(float) if weighted else np.ones(len(part))
        shared = spark.sparkContext.broadcast((act, th, sup))

        def scan(batches):
            act, th, sup = shared.value
            for pdf in batches:
                x = pdf[xs].to_numpy(dtype=float)
                obs = ~np.isnan(x)
                z = np.where(obs, (x - mu) / sd, 0.0) if root is None else (
                    np.where(obs, x, fill) - mu) / sd
                num, den, cnt = (pdf[c].to_numpy().copy() for c in ("__num", "__den", "__k"))
                pats, inv = np.unique(obs, axis=0, return_inverse=True)
                inv = inv.ravel()
                for k, o in enumerate(pats):
                    m = np.flatnonzero(~(act & ~o).any(1))
                    if not m.size:
                        continue
                    at = np.flatnonzero(inv == k)
                    eta = z[at] @ th[m, :d].T + th[m, d]
                    p = 1 / (1 + np.exp(-np.clip(eta, -35, 35)))
                    num[at] += p @ sup[m]
                    den[at] += sup[m].sum()
                    cnt[at] += m.size
                yield pdf.assign(__num=num, __den=den, __k=cnt)

        cur = cur.mapInPandas(scan, schema)
    miss = F.lit(float(prior))
    if root is not None:
        e = F.lit(float(base[d]))
        for j, x in enumerate(xs):
            e = e + F.lit(float(base[j])) * (F.coalesce(F.col(x), F.lit(float(fill[j]))) - float(mu[j])) / float(sd[j])
        miss = 1 / (1 + F.exp(-e))
    p = F.when(F.col("__den") > 0, F.col("__num") / F.col("__den")).otherwise(miss)
    return cur.select(*state, F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)).alias(out),
                      F.col("__k").alias("n_models"))


def ancestor_discrepancy(theta: DataFrame, edges: DataFrame, fitted: DataFrame) -> DataFrame:
    """(child, parent, sizes, n_shared, mean_abs_diff) over the variables an edge shares."""
    t = theta.where(F.col("var") != INTERCEPT)
    c = t.select(F.col("pattern").alias("child"), "var", F.col("value").alias("cv"))
    p = t.select(F.col("pattern").alias("parent"), "var", F.col("value").alias("pv"))
    j = edges.join(c, "child").join(p, ["parent", "var"])
    a = j.groupBy("child", "parent").agg(F.count(F.lit(1)).alias("n_shared"),
                                         F.avg(F.abs(F.col("cv") - F.col("pv"))).alias("mean_abs_diff"))
    size = fitted.select("pattern", "size")
    return (a.join(size.withColumnRenamed("pattern", "child").withColumnRenamed("size", "pattern_size"), "child")
            .join(size.withColumnRenamed("pattern", "parent").withColumnRenamed("size", "ancestor_size"), "parent"))


def median_support(fitted: DataFrame) -> float:
    """kappa policy: median support of the fitted patterns, from the training rows alone."""
    from sitelattice.operators.ordered import quantiles
    return float(quantiles(fitted, [], "support", [0.5]).first()["q"])


# The kappas tried by cross-validation.
KAPPA_GRID = [0.0, 200.0, 500.0, 1_000.0, 2_000.0, 5_000.0, 10_000.0, 50_000.0, 1e6, float("inf")]


def predict_at(df: DataFrame, xs: list[str], theta: DataFrame, fitted: DataFrame, kappas: list[float],
               carry: list[str], **kw) -> DataFrame:
    """(carry, kappa, p): cover predictions at every kappa of ``theta``."""
    cur = df
    for i, k in enumerate(kappas):
        cur = cover_predict(cur, xs, theta.where(F.col("kappa") == float(k)), fitted, out=f"__p{i}", **kw).drop("n_models")
    cells = F.array(*[F.struct(F.lit(float(k)).alias("kappa"), F.col(f"__p{i}").alias("p")) for i, k in enumerate(kappas)])
    return cur.select(*carry, F.inline(cells))


def choose_kappa(scores: DataFrame, y: str) -> DataFrame:
    """(kappa, mean_auprc) best first over inner folds; ties go to the smaller finite kappa."""
    from sitelattice.operators.metrics import score_metrics
    m = score_metrics(scores, ["fold", "kappa"], y).groupBy("kappa").agg(F.avg("auprc").alias("mean_auprc"))
    return m.orderBy(F.desc("mean_auprc"), F.asc("kappa"))


# --- fused regression ----------------------------------------------------------------------

def predict_fused(df: DataFrame, xs: list[str], theta: DataFrame, assigned: DataFrame, prior: float,
                  mu: np.ndarray, sd: np.ndarray, out: str = "p") -> DataFrame:
    """Score every row with its assigned pattern; rows with none get the prior."""
    d = len(xs)
    t = theta.groupBy(F.col("pattern").alias("assigned")).agg(
        *[F.max(F.when(F.col("var") == j, F.col("value"))).alias(f"__t{j}") for j in range(d)],
        F.max(F.when(F.col("var") == INTERCEPT, F.col("value"))).alias("__b"))
    j = (df.withColumn("__k", pattern_key(xs))
         .join(assigned.select(F.col("pattern").alias("__k"), "assigned").join(t, "assigned", "left"), "__k", "left"))
    z = F.col("__b")
    for i, x in enumerate(xs):
        z = z + F.coalesce(F.col(f"__t{i}") * (F.col(x) - float(mu[i])) / float(sd[i]), F.lit(0.0))
    p = F.coalesce(1 / (1 + F.exp(-z)), F.lit(float(prior)))
    return j.select(*df.columns, F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6)).alias(out))
