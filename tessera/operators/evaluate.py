"""Agreement of decisions with labels, and of searches with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(decided: DataFrame, truth: str = "label", approved: str = "approved") -> DataFrame:
    """A denied fraud is a true positive.  One pass, one row."""
    bad, denied = F.col(truth) == 1, ~F.col(approved)
    return decided.agg(
        F.count_if(bad & denied).alias("tp"),
        F.count_if(~bad & ~denied).alias("tn"),
        F.count_if(~bad & denied).alias("fp"),
        F.count_if(bad & ~denied).alias("fn"),
        F.count_if(bad != denied).alias("errors"),
    )


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """How often a search agrees with exact search: decision, neighbours."""
    both = found.alias("a").join(exact.alias("b"), F.col("a.qid") == F.col("b.qid"))
    return both.agg(
        F.count("*").alias("queries"),
        F.count_if(F.col("a.approved") == F.col("b.approved")).alias("same_decision"),
        F.count_if((F.col("a.sum_dist") == F.col("b.sum_dist")) & (F.col("a.sum_id") == F.col("b.sum_id"))).alias("same_neighbours"),
    )
