"""Train and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ordering import group_ranks, stable_key


def _known_only(test: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    for key in keys:
        test = test.join(train.select(key).distinct(), key, "left_semi")
    return test


def chronological_split(ratings: DataFrame, tie_break: list[str], train_share: float = 0.8,
                        ) -> tuple[DataFrame, DataFrame]:
    """First `train_share` of each user's rows by time, at least one and at most all but one.

    A user with one row is train only. Test rows of users or items unknown to train are left out.
    """
    ranked = group_ranks(ratings, ["user_id"], ["ts", *tie_break])
    n = F.col("group_size")
    cutoff = F.when(n == 1, 1).otherwise(F.least(F.greatest(F.floor(n * train_share), F.lit(1)), n - 1))
    marked = ranked.select(*ratings.columns, (F.col("rn") <= cutoff).alias("_train"))
    marked = cut_lineage(marked)
    train = marked.filter("_train").drop("_train")
    test = marked.filter("NOT _train").drop("_train")
    return train, _known_only(test, train, ["user_id", "item_id"])


def hashed_split(ratings: DataFrame, keys: list[str], test_share: float = 0.2, seed: int = 42,
                 per_user: bool = True) -> tuple[DataFrame, DataFrame]:
    """Random split by hash of `keys` (unique per row), stratified by user unless `per_user` is off.

    Each user gives ceil(test_share * n) of n rows to the test set, but never all: a user with one row
    is train only. Per user, train and test together are the input; unless `per_user`, test rows of users
    unknown to train are left out.
    """
    hashed = ratings.withColumn("_h", stable_key(keys, seed))
    group = ["user_id"] if per_user else []
    if per_user:
        ranked = group_ranks(hashed, group, ["_h", *keys])
        wanted = F.ceil(F.col("group_size") * F.lit(test_share))
        marked = ranked.withColumn("_test", F.col("rn") <= F.least(wanted, F.col("group_size") - 1))
    else:
        # The hash is uniform, so a cut on its first 8 hex digits is a cut on the rows.
        edge = f"{int(test_share * 16 ** 8):08x}"
        marked = hashed.withColumn("_test", F.substring("_h", 1, 8) < edge)
    marked = cut_lineage(marked.select(*ratings.columns, "_test"))
    train = marked.filter("NOT _test").drop("_test")
    test = marked.filter("_test").drop("_test")
    return train, test if per_user else _known_only(test, train, ["user_id"])
