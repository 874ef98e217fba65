"""Trees on missingness masks and the reduced-feature ensemble of trees. Boosting by group: ``grouped_trees``."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelattice.operators.patterns import packed_words, word_names, _bit
from sitelattice.operators.ordered import hash_row_number
from sitelattice.session import materialise

def mask_informativeness(df: DataFrame, xs: list[str], y: str, ids: list[str], seed=0, folds: int = 5,
                         iterations: int = 20) -> DataFrame:
    """One row (iota, n): out-of-fold AUROC of mask -> outcome minus one half.

    The mask is all the learner sees, so rows collapse to weighted (pattern, fold, class)
    cells before any tree is grown.
    """
    d = len(xs)
    slim = df.select(*ids, y, *packed_words(xs))
    f = hash_row_number(slim, [y], ids, f"iota/{seed}")
    cells = materialise(f.withColumn("fold", F.pmod(F.col("rn") - 1, F.lit(folds)).cast("int")).groupBy(
        *word_names(d), y, "fold").agg(F.count(F.lit(1)).cast("double").alias("w")))
    bits = cells.select("*", *[_bit(j).cast("double").alias(f"b{j}") for j in range(d)])
    feats = materialise(VectorAssembler(inputCols=[f"b{j}" for j in range(d)], outputCol="features").transform(bits)
                        .select(y, "fold", "w", "features"))
    out = None
    for k in range(folds):
        m = GBTClassifier(featuresCol="features", labelCol=y, weightCol="w", maxIter=iterations,
                          maxDepth=4, seed=seed).fit(feats.where(F.col("fold") != k))
        s = m.transform(feats.where(F.col("fold") == k)).select(
            y, "w", vector_to_array("probability")[1].alias("p"))
        out = s if out is None else out.unionByName(s)
    from sitelattice.operators.ordered import running_by_value
    run = running_by_value(out, [], "p", {"n": F.col("w"), "pos": F.col("w") * F.col(y)})
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    a = run.agg(F.sum("n").alias("n"), F.sum("pos").alias("P"), F.sum(F.col("pos") * rank).alias("rs"))
    auc = (F.col("rs") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * (F.col("n") - F.col("P")))
    return a.select((auc - 0.5).alias("iota"), F.col("n").cast("bigint").alias("n"))


def reduced_feature_trees(train: DataFrame, test: DataFrame, y: str, xs: list[str], ids: list[str],
                          depth: int = 8) -> DataFrame:
    """Tree form of the reduced-feature ensemble: members in long form, averaged per row."""
    from sitelattice.operators.matrix import impute_mean
    stats = train.agg(*[F.avg(x).alias(x) for x in xs]).first()
    fill = {x: float(stats[x] or 0.0) for x in xs}
    gaps = train.agg(*[F.count_if(F.col(x).isNull()).alias(x) for x in xs]).first()
    ever = [x for x in xs if gaps[x] > 0]
    tr, te = train.fillna(fill), test.select("*", *[F.col(x).isNull().alias(f"__m_{x}") for x in xs]).fillna(fill)
    full = F.lit(True)
    for x in ever:
        full = full & ~F.col(f"__m_{x}")
    out = None
    for left in [None, *ever]:
        use = [x for x in xs if x != left]
        va = VectorAssembler(inputCols=use, outputCol="features")
        m = DecisionTreeClassifier(featuresCol="features", labelCol=y, maxDepth=depth).fit(va.transform(tr))
        rows = te.where(full if left is None else F.col(f"__m_{left}"))
        s = m.transform(va.transform(rows)).select(*ids, y, vector_to_array("probability")[1].alias("p"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy(*ids).agg(F.first(y).alias(y), F.avg("p").alias("p"))
