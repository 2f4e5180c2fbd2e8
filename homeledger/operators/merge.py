"""Merging the records of a duplicate group into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGEST = ["description"]
NON_ZERO = ["price", "rent_estimate"]
UNION = ["images"]
MAPS = ["features"]


def merged_images(df: DataFrame, group: str = "group_id", name: str = "images") -> DataFrame:
    """``(group, image)``: each image of a group once, as rows; a group of any size stays spread."""
    return df.select(group, F.explode(name).alias("image")).distinct()


def merged_features(
    df: DataFrame, group: str = "group_id", order: str = "ingest_seq", name: str = "features"
) -> DataFrame:
    """``(group, key, value)``: the latest value of each feature of a group, as rows."""
    each = df.select(group, order, F.explode(name).alias("key", "value"))
    return each.groupBy(group, "key").agg(F.max_by("value", order).alias("value"))


def merge_groups(
    df: DataFrame, group: str = "group_id", order: str = "ingest_seq", nested: bool = True
) -> DataFrame:
    """One record per group.

    The first non-empty value wins, except: the longest description (earliest on
    ties), the first non-zero price or rent, the union of images, and for
    features the latest value of each key. All of it is mergeable aggregation, so
    map tasks pre-combine a hot group before the shuffle.

    ``nested`` gathers a group's images and features into an array and a map, as records hold them. Where
    groups may have any number of them, leave it out and take :func:`merged_images` and
    :func:`merged_features` as tables beside the records: nothing is collected then.
    """
    special = {*UNION, *MAPS, group, order}
    seq = F.col(order)
    aggs: list[Column] = [F.min(seq).alias(order), F.count("*").alias("merged_rows")]
    for f in df.schema.fields:
        if f.name in special:
            continue
        c = F.col(f.name)
        filled = c.isNotNull()
        if isinstance(f.dataType, T.StringType):
            filled = filled & (c != "")
        if f.name in LONGEST:
            rank = F.struct(F.length(c), -seq)
            agg = F.max_by(c, F.when(filled, rank))
        elif f.name in NON_ZERO:
            agg = F.coalesce(
                F.min_by(c, F.when(filled & (c != 0), seq)), F.min_by(c, F.when(filled, seq))
            )
        else:
            agg = F.min_by(c, F.when(filled, seq))
        aggs.append(agg.alias(f.name))
    out = df.groupBy(group).agg(*aggs)
    if not nested:
        return out
    for name in UNION:
        if name in df.columns:
            parts = merged_images(df, group, name).groupBy(group)
            out = out.join(parts.agg(F.sort_array(F.collect_list("image")).alias(name)), group, "left")
    for name in MAPS:
        if name in df.columns:
            entries = F.sort_array(F.collect_list(F.struct("key", "value")))
            latest = merged_features(df, group, order, name).groupBy(group).agg(F.map_from_entries(entries).alias(name))
            out = out.join(latest, group, "left")
    return out
