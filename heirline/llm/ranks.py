"""Ranks within large groups, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heirline.plans.prefix import running_total
from heirline.plans.scratch import Scratch


def running_rank(scratch: Scratch, df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add ``name``: the place of each row in its group by ``order``, from 0.

    The group is one key of a sort over all rows, which is dealt out in ranges; equal rows get different ranks.
    """
    return running_total(scratch, df, order, F.lit(1), name, group)
