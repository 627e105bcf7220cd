"""Upper tails of F, chi-squared and t by the commons-math3 that Spark ships, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _beta(x: Column, a: Column, b: Column) -> Column:
    return F.java_method(F.lit("org.apache.commons.math3.special.Beta"), F.lit("regularizedBeta"), x.cast("double"), a.cast("double"), b.cast("double")).cast("double")


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    return F.when(f <= 0, 1.0).otherwise(_beta(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0))


def chi2_tail(x: Column, df: Column) -> Column:
    tail = F.java_method(F.lit("org.apache.commons.math3.special.Gamma"), F.lit("regularizedGammaQ"), (df / 2.0).cast("double"), (F.greatest(x, F.lit(0.0)) / 2.0).cast("double"))
    return tail.cast("double")


def t_two_sided(t: Column, df: Column) -> Column:
    return _beta(df / (df + t * t), df / 2.0, F.lit(0.5))
