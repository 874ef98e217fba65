"""Missingness patterns: counts, superset support, containment order, row assignment.

A pattern is the set of observed variables, packed into BIGINT words ``w0, w1, ..`` of 62
bits. Rows collapse to distinct patterns first; everything after that works on patterns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 62
#: Large patterns of one variable that share a slice of the containment index.
SLICE_PATTERNS = 20_000


def word_names(d: int) -> list[str]:
    return [f"w{k}" for k in range((d + BITS - 1) // BITS)]


def observed_set(xs: list[str]) -> Column:
    """Sorted array of the observed variables' indices."""
    return F.array_compact(F.array(
        *[F.when(F.col(x).isNotNull(), F.lit(j)) for j, x in enumerate(xs)]))


def packed_words(xs: list[str]) -> list[Column]:
    """Observed set as bit words; sums of shifted flags stay inside generated code."""
    out = []
    for k, name in enumerate(word_names(len(xs))):
        part = xs[k * BITS:(k + 1) * BITS]
        bits = [F.shiftleft(F.col(x).isNotNull().cast("bigint"), i) for i, x in enumerate(part)]
        out.append(sum(bits[1:], bits[0]).alias(name))
    return out


def _bit(j: int) -> Column:
    return F.shiftright(F.col(f"w{j // BITS}"), j % BITS).bitwiseAND(F.lit(1))


def _vars_of(d: int) -> Column:
    """Variable indices back from the words."""
    return F.array_compact(F.array(*[F.when(_bit(j) == 1, F.lit(j)) for j in range(d)]))


def describe(patterns: DataFrame, d: int) -> DataFrame:
    """Add ``vars`` (array), ``size`` and the text key ``pattern``."""
    return (patterns.withColumn("vars", _vars_of(d))
            .withColumn("size", F.size("vars"))
            .withColumn("pattern", F.concat_ws(",", F.col("vars").cast("array<string>"))))


def pattern_counts(df: DataFrame, xs: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """Distinct patterns with the rows that realise each exactly."""
    words = word_names(len(xs))
    slim = df.select(*packed_words(xs), *[c.alias(k) for k, c in (extra or {}).items()])
    agg = slim.groupBy(*words).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in (extra or {})])
    return describe(agg, len(xs))


def _inside(words: list[str], small: str, large: str) -> Column:
    cond = F.lit(True)
    for w in words:
        cond = cond & (F.col(f"{small}.{w}").bitwiseAND(F.col(f"{large}.{w}")) == F.col(f"{small}.{w}"))
    return cond


def _rarest(rare: list[int], but: Column | None = None) -> Column:
    """A pattern's first variable in the order of ``rare``, other than ``but``; -1 if it has none."""
    able = [F.when((_bit(j) == 1) & (F.lit(True) if but is None else but != j), F.lit(j)) for j in rare]
    return F.coalesce(*able, F.lit(-1))


def containment(small: DataFrame, large: DataFrame, d: int, strict: bool = False, slice_patterns: int = SLICE_PATTERNS) -> DataFrame:
    """Pairs small <= large as aliases ``e`` and ``o``.

    An index of containment: a small pattern is filed under its two rarest variables, a large one is offered
    under every such pair that it holds (at most d * d pairs exist, so they go to every task), and the bit test is
    the residual condition. Large patterns of a frequent variable are dealt over slices of ``slice_patterns``, and the
    small ones go to each of them, so no key holds more than its share.
    """
    words = word_names(d)
    seen = large.agg(F.count(F.lit(1)).alias("all"), *[F.sum(_bit(j)).alias(f"v{j}") for j in range(d)]).first()
    count = [seen[f"v{j}"] or 0 for j in range(d)]
    rare = sorted(range(d), key=lambda j: (count[j], j))
    slices = F.array(*[F.lit(max(1, -(-n // slice_patterns))) for n in [*count, seen["all"]]])  # -1: the last
    held = F.element_at(slices, F.when(F.col("__a") < 0, -1).otherwise(F.col("__a") + 1))
    filed = small.withColumn("__a", _rarest(rare)).withColumn("__b", _rarest(rare, F.col("__a")))
    pairs = filed.select("__a", "__b").distinct()
    offered = large.withColumn("__a", F.explode(F.concat(F.array(F.lit(-1)), F.col("vars")))).join(F.broadcast(pairs), "__a")
    offered = offered.where((F.col("__b") < 0) | F.array_contains("vars", F.col("__b")))
    e = filed.withColumn("__slice", F.explode(F.sequence(F.lit(0), held - 1))).alias("e")
    o = offered.withColumn("__slice", F.pmod(F.xxhash64("pattern"), held).cast("int")).alias("o")
    cond = _inside(words, "e", "o")
    for c in ("__a", "__b", "__slice"):
        cond = cond & (F.col(f"e.{c}") == F.col(f"o.{c}"))
    if strict:
        cond = cond & (F.col("e.size") < F.col("o.size"))
    return e.join(o, cond)


def supports(fitted: DataFrame, realised: DataFrame, d: int) -> DataFrame:
    """(pattern, support): rows observing every variable of the pattern."""
    return containment(fitted, realised, d).groupBy(F.col("e.pattern").alias("pattern")).agg(
        F.sum("o.n").alias("support"))


def with_support(realised: DataFrame, d: int) -> DataFrame:
    return realised.join(supports(realised, realised, d), "pattern")


def immediate_ancestors(patterns: DataFrame, d: int) -> DataFrame:
    """(child, parent): maximal patterns strictly inside each pattern.

    The strictly contained patterns of a child meet in one group, largest first; one that lies
    inside a parent already found is not immediate.
    """
    words = word_names(d)
    pairs = containment(patterns, patterns, d, strict=True).select(
        F.col("o.pattern").alias("child"), F.col("e.pattern").alias("parent"), F.col("e.size").alias("size"),
        *[F.col(f"e.{w}").alias(w) for w in words])

    def parents(group: pd.DataFrame) -> pd.DataFrame:
        left = group.sort_values(["size", "parent"], ascending=[False, True])
        keys, bits = left["parent"].to_numpy(), left[words].to_numpy(dtype=np.int64)
        found, at = [], np.arange(len(keys))
        while at.size:
            top, at = at[0], at[1:]
            found.append(keys[top])
            at = at[((bits[at] & bits[top]) != bits[at]).any(axis=1)]
        return pd.DataFrame({"child": group["child"].iloc[0], "parent": found}, dtype=object)

    return pairs.groupBy("child").applyInPandas(parents, "child string, parent string")


def most_specific(fitted: DataFrame, realised: DataFrame, d: int) -> DataFrame:
    """(pattern, assigned): largest fitted subset; ties by the sorted variable list.

    Every realised pattern appears; ``assigned`` is NULL where no fitted pattern applies.
    """
    best = containment(fitted, realised, d).groupBy(F.col("o.pattern").alias("pattern")).agg(
        F.min(F.struct((-F.col("e.size")).alias("s"), F.col("e.vars").alias("v"),
                       F.col("e.pattern").alias("k"))).alias("b"))
    return realised.select("pattern", "n").join(
        best.select("pattern", F.col("b.k").alias("assigned")), "pattern", "left")


def cover(fitted: DataFrame, realised: DataFrame, d: int) -> DataFrame:
    """(pattern, member): every fitted pattern usable by rows of each realised pattern."""
    return containment(fitted, realised, d).select(
        F.col("o.pattern").alias("pattern"), F.col("e.pattern").alias("member"))
