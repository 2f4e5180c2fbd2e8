"""Property search, lookups and listing history reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.operators.grouped import previous_in_group, top_per_group
from homeledger.operators.tables import before
from homeledger.schema import VIEW_COLUMNS


@dataclass(frozen=True)
class Criteria:
    """Search filters and paging; ``None`` (or empty text) means "no filter"."""

    data_source: str | None = None
    property_type: int | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_bedrooms: float | None = None
    max_bedrooms: float | None = None
    min_bathrooms: float | None = None
    max_bathrooms: float | None = None
    min_sqft: float | None = None
    max_sqft: float | None = None
    city: str | None = None
    state: str | None = None
    zip_code: str | None = None
    order_by: str = "created_at"
    order_direction: str = "desc"
    limit: int | None = None
    offset: int = 0


def dollars_to_cents(value: float | None) -> int | None:
    """Price bound of the public search form to cents; 0 is a bound like any other."""
    return None if value is None else int(value * 100)


def page_offset(page: int, page_size: int) -> int:
    return (page - 1) * page_size


def equality_filters(df: DataFrame, **wanted) -> DataFrame:
    for name, value in wanted.items():
        if value is not None and value != "":
            df = df.filter(F.col(name) == value)
    return df


def range_filters(df: DataFrame, **bounds: tuple) -> DataFrame:
    """``column=(low, high)``, both ends inclusive, either one may be ``None``."""
    for name, (low, high) in bounds.items():
        if low is not None:
            df = df.filter(F.col(name) >= low)
        if high is not None:
            df = df.filter(F.col(name) <= high)
    return df


def contains_filters(df: DataFrame, **parts: str | None) -> DataFrame:
    """Case-insensitive substring; ``%`` and ``_`` in the input act as wildcards."""
    for name, part in parts.items():
        if part:
            df = df.filter(F.col(name).ilike(f"%{part}%"))
    return df


def ordering(name: str, direction: str, tie: str) -> list[Column]:
    """Nulls first on descending, last on ascending; the id breaks ties."""
    if direction.lower() == "desc":
        return [F.col(name).desc_nulls_first(), F.col(tie).asc()]
    return [F.col(name).asc_nulls_last(), F.col(tie).asc()]


def matching(properties: DataFrame, locations: DataFrame, c: Criteria) -> DataFrame:
    """Filtered property-location join. Both sides are filtered before the join."""
    p = equality_filters(properties, data_source=c.data_source, property_type=c.property_type)
    p = range_filters(
        p,
        price=(c.min_price, c.max_price),
        bedrooms=(c.min_bedrooms, c.max_bedrooms),
        bathrooms=(c.min_bathrooms, c.max_bathrooms),
        square_feet=(c.min_sqft, c.max_sqft),
    )
    own = set(p.columns)
    loc = locations.select(
        F.col("id").alias("location_id"), *[x for x in locations.columns if x not in own | {"id"}]
    )
    loc = contains_filters(loc, city=c.city, state=c.state)
    loc = equality_filters(loc, zip_code=c.zip_code)
    return p.join(loc, "location_id")


def search(properties: DataFrame, locations: DataFrame, c: Criteria) -> DataFrame:
    """One page of matches, by a distributed top-k; without a limit, all of them in order.

    Deep pages, and an offset without a limit, go by :func:`page` (actions).
    """
    found = matching(properties, locations, c)
    name = c.order_by if c.order_by in found.columns else "created_at"
    if c.offset and (c.limit is None or c.offset > SHALLOW):
        return page(found, name, c.order_direction, "property_id", c.offset, c.limit)
    found = found.orderBy(*ordering(name, c.order_direction, "property_id"))
    found = found.offset(c.offset) if c.offset else found
    return found if c.limit is None else found.limit(c.limit)


SHALLOW = 10_000  # rows that a top-k may keep per task
RANGES = 64
EDGE_ROWS = 4_000


def _edges(df: DataFrame, name: str, rows: int) -> list:
    """Values that cut a column into ranges, from a small sample; they steer the work, not the result."""
    given = df.select(name).filter(F.col(name).isNotNull())
    drawn = given.sample(min(1.0, EDGE_ROWS / max(1, rows)), seed=1).limit(4 * EDGE_ROWS).collect()
    values = sorted(r[0] for r in drawn)
    return sorted({values[len(values) * i // RANGES] for i in range(RANGES)}) if values else []


def page(df: DataFrame, name: str, direction: str, tie: str, offset: int, limit: int | None = None) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in the order of :func:`ordering`, however deep (actions).

    Rows are counted per range of the order column, which shows the ranges that hold the asked places; only
    those are sorted. A range of a single value is cut by ``tie`` in the same way. Without a limit the rows after the
    range that holds the first place are taken as they are and sorted by all tasks.
    """
    counts = df.agg(F.count("*"), F.count(name)).first()
    edges = _edges(df, name, counts[1])
    value = F.col(name)
    desc = direction.lower() == "desc"
    # -1 holds what is below all edges; nulls come last ascending, first descending.
    place = F.when(value.isNull(), len(edges)).otherwise(
        F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= value)) - 1 if edges else F.lit(-1)
    )
    sizes = {r.at: r.n for r in df.groupBy(place.alias("at")).agg(F.count("*").alias("n")).collect()}
    at, first, last, before = 0, None, None, 0
    for k in sorted(sizes, reverse=desc):
        if first is None and at + sizes[k] > offset:
            first, before = k, at
        if limit is None or at < offset + limit:
            last = k
        at += sizes[k]
    rows = df.withColumn("_at", place)
    order = ordering(name, direction, tie)
    if first is None or limit == 0:
        return df.limit(0)

    def within(a: int, b: int) -> DataFrame:
        return rows.filter(F.col("_at").between(min(a, b), max(a, b))).drop("_at")

    if limit is None:
        rest = rows.filter(F.col("_at") < first if desc else F.col("_at") > first).drop("_at")
        size = sizes[first]
        head = _few(within(first, first), name, direction, tie, offset - before, size - (offset - before), size)
        return head.unionByName(rest).orderBy(*order)
    return _few(within(first, last), name, direction, tie, offset - before, limit, sum(
        n for k, n in sizes.items() if min(first, last) <= k <= max(first, last)))


def _few(df: DataFrame, name: str, direction: str, tie: str, offset: int, limit: int, size: int) -> DataFrame:
    """A part of the rows of some ranges; a large range of one value is cut by the tie."""
    if size > SHALLOW and name != tie:
        ends = df.agg(F.min(name).alias("a"), F.max(name).alias("b"), F.count(name).alias("n")).first()
        if ends.n == 0 or ends.n == size and ends.a == ends.b:
            return page(df, tie, "asc", tie, offset, limit)
    return df.orderBy(*ordering(name, direction, tie)).offset(offset).limit(limit)


def page_after(
    df: DataFrame, name: str, direction: str, tie: str, last: tuple | None, limit: int
) -> DataFrame:
    """The next ``limit`` rows after the row with ``last = (value, tie)``; None: the first ones.

    A cursor needs no count and no offset: a filter and a top-k, the same at any depth.
    """
    if last is not None:
        value, key = last
        v, t = F.col(name), F.col(tie) > F.lit(key)
        desc = direction.lower() == "desc"
        if value is None:
            later = (v.isNull() & t) | (v.isNotNull() if desc else F.lit(False))
        else:
            further = v < F.lit(value) if desc else v > F.lit(value)
            later = further | ((v == F.lit(value)) & t) | (F.lit(False) if desc else v.isNull())
        df = df.filter(later)
    return df.orderBy(*ordering(name, direction, tie)).limit(limit)


def match_count(properties: DataFrame, locations: DataFrame, c: Criteria) -> DataFrame:
    return matching(properties, locations, c).agg(F.count("*").alias("total_count"))


def by_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key is in ``keys`` (null-safe); the bulk form of a lookup by id."""
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"k.{c}")) for c in on]
    return df.alias("d").join(keys.select(*on).alias("k"), same, "left_semi")


def stale(
    df: DataFrame, as_of: Column, hours: int = 24, limit: int | None = None,
    ts: str = "last_scraped", tie: str = "property_id",
) -> DataFrame:
    """Rows not scraped for ``hours``; with a limit, the oldest ones."""
    old = before(df, ts, as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return old if limit is None else old.orderBy(F.col(ts).asc(), F.col(tie).asc()).limit(limit)


def locations_in_area(
    locations: DataFrame, city: str, state: str, limit: int | None = None
) -> DataFrame:
    found = contains_filters(locations, city=city, state=state)
    return found if limit is None else found.orderBy("id").limit(limit)


def listings_of(listings: DataFrame, property_ids: DataFrame) -> DataFrame:
    """Listings of the given properties; sorting is left to the reader, who may take a part."""
    return by_keys(listings, property_ids, ["property_id"])


def latest_listing(listings: DataFrame) -> DataFrame:
    return top_per_group(
        listings, ["property_id"], [F.col("created_at").desc(), F.col("id").desc()]
    )


def price_history(listings: DataFrame) -> DataFrame:
    """One event per price change between consecutive listings of a property."""
    prev = previous_in_group(
        listings, ["property_id"], "created_at", "id", "list_price", "old_price"
    )
    old = F.coalesce(F.col("old_price"), F.lit(0))
    divisor = F.when(old == 0, F.lit(1)).otherwise(old)
    amount = F.col("list_price") - old
    return (
        prev.filter(F.col("old_price_exists"))
        .filter(~F.col("list_price").eqNullSafe(F.col("old_price")))
        .select(
            "property_id",
            "id",
            F.col("created_at").alias("date"),
            "old_price",
            F.col("list_price").alias("new_price"),
            amount.alias("change_amount"),
            (amount / divisor * F.lit(100.0)).alias("change_percent"),
        )
    )


def with_metrics(properties: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics next to each property; ``has_metrics`` is false where there are none."""
    m = metrics.drop("id", "created_at", "updated_at").withColumn("_m", F.lit(True))
    return (
        properties.join(m, "property_id", "left")
        .withColumn("has_metrics", F.coalesce(F.col("_m"), F.lit(False)))
        .drop("_m")
    )


def properties_view(properties: DataFrame) -> DataFrame:
    """The 23-column analyst view; sorting is left to the reader."""
    return properties.select(*VIEW_COLUMNS)
