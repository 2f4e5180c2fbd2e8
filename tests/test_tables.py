"""Stored versions, clustered tables, deep pages, location ids and merged child rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from homeledger.functions import address
from homeledger.operators import dedup, merge, search, tables
from homeledger.plans.fixtures import events_as_of, located_properties, table
from homeledger.schema import schema_of
from homeledger.sinks import files as sinks
from homeledger.sinks import versions

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def stored(spark, scratch):
    path = f"{scratch}/t"
    df = spark.range(2000).select(F.col("id").alias("property_id"), (F.col("id") * 2).alias("price"),
                                  F.lit(None).cast("timestamp").alias("updated_at"))
    versions.create(df, path, "property_id", buckets=50)
    return df, path


def files_of(df):
    return set(df.inputFiles())


def test_a_change_rewrites_the_touched_buckets(spark, stored):
    df, path = stored
    before = versions.read(spark, path)
    assert rows(before) == rows(df)
    now = F.lit("2024-01-01").cast("timestamp")
    updates = spark.range(10).select((F.col("id") * 7).alias("property_id"), F.array(F.lit("price")).alias("set_fields"),
                                     F.lit(-1).cast("bigint").alias("price"))
    step = lambda old: tables.update_rows(old, updates, "property_id", now, ["price"])
    assert versions.change(spark, path, updates, step) == 1
    after = versions.read(spark, path)
    assert rows(after) == rows(tables.update_rows(df, updates, "property_id", now, ["price"]))
    assert len(files_of(after) - files_of(before)) <= 10 and len(files_of(after) & files_of(before)) >= 40
    # The old version stays as it was.
    assert rows(versions.read(spark, path, 0)) == rows(df) and versions.versions(spark, path) == [0, 1]
    assert versions.change(spark, path, updates.limit(0), step) == 1


def test_deletes_inserts_and_look_ups(spark, stored):
    df, path = stored
    gone = spark.range(0, 500, 100).select(F.col("id").alias("property_id"))
    versions.change(spark, path, gone, lambda old: tables.delete_rows(old, gone))
    new = spark.range(5000, 5003).select(F.col("id").alias("property_id"), F.lit(1).cast("bigint").alias("price"))
    versions.change(spark, path, new, lambda old: old.unionByName(new, allowMissingColumns=True))
    want = rows(tables.append_rows(tables.delete_rows(df, gone), new))
    assert rows(versions.read(spark, path)) == want
    found = versions.lookup(spark, path, new.limit(2))
    assert {r.property_id for r in found.collect()} <= {5000, 5001, 5002} and found.count() == 2
    assert len(files_of(found)) <= 2
    everyone = versions.read(spark, path).select("property_id")
    versions.change(spark, path, everyone, lambda old: old.limit(0))
    assert versions.read(spark, path).count() == 0 and versions.read(spark, path).columns == df.columns


def test_a_failed_or_overtaken_change_changes_nothing(spark, stored):
    df, path = stored
    some = df.filter("property_id < 20")
    boom = F.udf(lambda x: 1 // 0, "bigint")
    with pytest.raises(Exception, match="division"):
        versions.change(spark, path, some, lambda old: old.withColumn("price", boom("price")))
    with pytest.raises(ValueError, match="not asked"):
        versions.change(spark, path, df.filter("property_id = 1"), lambda old: old.withColumn("property_id", F.expr("property_id + 1")))

    def overtaken(old):
        versions.change(spark, path, some, lambda rows: tables.delete_rows(rows, some))
        return old

    with pytest.raises(versions.ChangedMeanwhile):
        versions.change(spark, path, some, overtaken)
    assert rows(versions.read(spark, path)) == rows(df.filter("property_id >= 20"))
    assert rows(versions.read(spark, path, 0)) == rows(df)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path, 9)


def files_read(df):
    """Files that the scans of a run plan have opened."""
    df.collect()
    scans, found = [df._jdf.queryExecution().executedPlan()], 0
    while scans:
        node = scans.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            scans.append(node.executedPlan())
            continue
        metric = node.metrics().get("numFiles")
        found += metric.get().value() if metric.isDefined() else 0
        children = node.children()
        scans += [children.apply(i) for i in range(children.size())]
    return found


def test_clustered_tables_open_the_days_they_need(spark, scratch):
    events = table(spark, SF, "events")
    stored = sinks.save_clustered(events, f"{scratch}/e", "ts", "event_id")
    total = files_read(stored.select("event_id"))
    as_of = events_as_of()
    kept = tables.retain_days(stored, "ts", as_of, 3)
    assert rows(kept.drop("ts_day")) == rows(tables.retain_days(events, "ts", as_of, 3))
    assert 0 < files_read(kept) < total / 4
    old = search.stale(stored, as_of, 24 * 27, ts="ts", tie="event_id")
    assert rows(old.drop("ts_day")) == rows(search.stale(events, as_of, 24 * 27, ts="ts", tie="event_id"))
    assert 0 < files_read(old) < total / 2
    props = located_properties(spark, SF)
    plain = sinks.save_table(props, f"{scratch}/p", "properties")
    typed = sinks.save_table(props, f"{scratch}/c", "properties", cluster=("created_at", "property_id"))
    assert plain.schema == schema_of("properties")
    assert typed.drop("created_at_day").schema == plain.schema and rows(typed.select("property_id")) == rows(plain.select("property_id"))


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("name", ["v", "s", "t"])
def test_deep_pages(spark, direction, name, monkeypatch):
    rng = random.Random(name)
    given = [(i, rng.choice([None, 7.0, rng.random() * 50]), rng.choice([None, "x", chr(97 + rng.randrange(26))]), 3)
             for i in range(900)]
    df = spark.createDataFrame(given, "id long, v double, s string, t int")
    want = [r.id for r in df.orderBy(*search.ordering(name, direction, "id")).collect()]
    monkeypatch.setattr(search, "SHALLOW", 100)
    for offset, limit in ((0, 10), (250, 40), (899, 5), (900, 5), (1200, None), (300, None), (0, None), (450, 300)):
        got = [r.id for r in search.page(df, name, direction, "id", offset, limit).collect()]
        assert got == (want[offset:] if limit is None else want[offset : offset + limit]), (offset, limit)
    got, last = [], None
    while len(got) < 900:
        found = search.page_after(df, name, direction, "id", last, 170).collect()
        got += [r.id for r in found]
        last = (found[-1][name], found[-1].id)
    assert got == want


def test_deep_pages_leave_most_rows_unsorted(spark):
    df = spark.range(20_000).select("id", (F.rand(3) * 1000).alias("v"))
    plan = search.page(df, "v", "asc", "id", 15_000, 20)._jdf.queryExecution().executedPlan().toString()
    # The top-k is one of a range, not of all rows before the page.
    assert int(re.search(r"TakeOrderedAndProject\(limit=(\d+)", plan)[1]) < 2_000


def test_location_ids_that_clash(spark):
    keys = dedup.ADDRESS_KEYS
    rng = random.Random(2)
    streets = [(f"{i} Oak Street", rng.choice(["A", "B", None, ""]), "CA", "90210") for i in range(600)]
    df = spark.createDataFrame(streets, ", ".join(f"{c} string" for c in keys))
    short = lambda turn: F.pmod(address.location_id(*[F.col(c) for c in keys], turn=turn), F.lit(1000))
    old = spark.createDataFrame([(i, *s) for i, s in enumerate(streets[:100])], "id long, " + ", ".join(f"{c} string" for c in keys))
    got = dedup.resolve_locations(df.union(df), old, short)
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) == 500 and not set(ids) & set(range(100))
    assert rows(got.select(*keys)) == rows(df.join(old, keys, "left_anti").exceptAll(df.limit(0)).select(*keys).subtract(old.select(*keys)))
    again = dedup.resolve_locations(df.orderBy(F.rand(5)).repartition(7), old, short)
    assert rows(again) == rows(got)
    # Without a clash the ids are the plain ones.
    plain = dedup.resolve_locations(df, old)
    same = plain.filter(F.col("id") == address.location_id(*[F.col(c) for c in keys]))
    assert same.count() == plain.count() == 500
    assert dedup.resolve_locations(df.limit(0), old).count() == 0


def test_children_of_a_hot_group(spark):
    """A third of all rows in one group: its images and features stay rows."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("group_id"), F.col("id").alias("ingest_seq"),
        F.array(F.concat(F.lit("i"), F.col("id") % 700)).alias("images"),
        F.create_map(F.concat(F.lit("k"), F.col("id") % 50), F.col("id").cast("string")).alias("features"))
    slim, full = merge.merge_groups(df, nested=False), merge.merge_groups(df)
    assert not {"images", "features"} & set(slim.columns) and slim.count() == full.count()
    for frame in (slim, merge.merged_images(df), merge.merged_features(df)):
        assert "collect_list" not in frame._jdf.queryExecution().toString()
    hot = full.filter("group_id = 0").first()
    images = merge.merged_images(df).filter("group_id = 0")
    assert sorted(r.image for r in images.collect()) == hot.images
    assert {r.key: r.value for r in merge.merged_features(df).filter("group_id = 0").collect()} == hot.features
