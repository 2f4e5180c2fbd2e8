"""Column functions against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from homeledger.functions import address, listing, money, text
from homeledger.functions.similarity import numeric_similarity, score_pairs
from homeledger.operators import metrics


def apply(spark, fn, values, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    rows = df.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_clean_text(spark):
    got = apply(spark, text.clean_text, [
        "  <b>Nice</b>\n\t home  ", "a  b", "", None, "<p> x </p>", "1 < 2"])
    assert got == ["Nice home", "a b", "", None, " x ", "1 < 2"]


def test_clean_price(spark):
    got = apply(spark, money.clean_price, [
        "$1,200+", "$1,200 - $1,800", "900 per month", "900 PER month", "1,200/mo", "-500", "", None,
        "12d", "1.5e3", " 7. ", "$3500/month"])
    assert got == [1200.0, 1200.0, 900.0, None, None, None, None, None, None, 1500.0, 7.0, None]


def test_amount_from_text(spark):
    got = apply(spark, money.amount_from_text, [
        "$3500/month", "1500 dollars", "call, 900 usd", "no price", "$1,234.50", None])
    assert got == [3500.0, 1500.0, 900.0, None, 1234.5, None]


def test_area_from_text(spark):
    got = apply(spark, money.area_from_text, [
        "1,200 sq. ft.", "1200sf", "950.7 Square Feet", "800", "big", None])
    assert got == [1200, 1200, 950, 800, None, None]


def test_rent_from_range(spark):
    got = apply(spark, money.rent_from_range, [
        "$1,200 - $1,800", "$1,250.99/mo", "ask", "0 - 500", ",", None])
    assert got == [1500.0, 1250.0, None, 0.0, None, None]


def test_to_cents(spark):
    got = apply(spark, money.to_cents, [19.99, 0.0, 99999.99, 100000.0, None, -5.0], "double")
    assert got == [1998.0, 0.0, 9999999.0, 100000.0, None, -500.0]
    kept = apply(spark, lambda c: money.to_cents(c, already_cents=True), [19.0], "double")
    assert kept == [19.0]


def test_state_and_zip(spark):
    assert apply(spark, address.standard_state, [" texas ", "ny", "Ontario", "", None]) == [
        "TX", "NY", "ONTARIO", "", ""]
    assert apply(spark, address.standard_zip, ["90210-1234", " 1234 ", "x123456", "", None]) == [
        "90210", "1234", "12345", "", ""]


def test_fingerprint_shortens_words_in_order(spark):
    import hashlib
    df = spark.createDataFrame(
        [("12 Broadway Street", " Anytown", "CA", "90210 "), (None, None, None, None)],
        "s string, c string, t string, z string")
    got = [r[0] for r in df.select(address.fingerprint(*map(F.col, "sctz"))).collect()]
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert got == [md5("12 brdway st anytown ca 90210"), md5("   ")]


def test_split_address(spark):
    df = spark.createDataFrame(
        [("1 Main St, Anytown, CA 90210",), ("no commas",), ("a, b, ",), ("x, Y, NY",)], "v string")
    parts = address.split_address(F.col("v"))
    got = [tuple(r) for r in df.select(*parts.values()).collect()]
    assert got == [("Anytown", "CA", "90210"), (None, None, None), ("b", None, None), ("Y", "NY", None)]


def test_resolve_link(spark):
    got = apply(spark, lambda c: address.resolve_link(c, "https://h.example"), [
        "/a/b", "x/y", "https://o.example/z", "//c.example/q", "", None])
    assert got == ["https://h.example/a/b", "https://h.example/x/y", "https://o.example/z",
                   "https://c.example/q", "https://h.example", None]


def test_type_from_text_order(spark):
    got = apply(spark, listing.type_from_text, [
        "Townhouse", "Townhome", "Condo lot", "duplex", "Lot", "castle", "", None])
    assert got == [1, 4, 3, 5, 6, 8, 8, 8]


def test_rooms(spark):
    t = ["3 bds2.5 ba1,234 sqft", "Studio, 1 Bath", "2BEDROOM", ", sq ft", None]
    assert apply(spark, lambda c: listing.bedrooms(c, studio=True), t) == [3, 0, 2, None, None]
    assert apply(spark, listing.bedrooms, ["studio"]) == [None]
    assert apply(spark, listing.bathrooms, t) == [2.5, 1.0, None, None, None]
    assert apply(spark, listing.square_feet, t) == [1234, None, None, None, None]


def test_small_text_functions(spark):
    assert apply(spark, text.keep_number, ["1.5 ba", "a", "1,200", "1.2.3", None]) == [
        1, None, 1200, None, None]
    assert apply(spark, text.first_decimal, ["4.5 of 5", "x", "..", None]) == [4.5, None, None, None]
    assert apply(spark, listing.status_from_text, ["Sale Pending", "SOLD", "x", None]) == [
        "pending", "sold", "active", "active"]
    assert apply(spark, listing.available_now, ["Not available", "Jan 1", None]) == [True, None, None]
    assert apply(spark, listing.trailing_id, ["/a/12/", "/a/12", "/12/b"]) == ["12", "12", None]


def test_distance(spark):
    d = spark.range(1).select(
        listing.distance_km(F.lit(34.0522), F.lit(-118.2437), F.lit(40.7128), F.lit(-74.006))).first()[0]
    assert d == pytest.approx(3935.7, abs=1.0)


def test_numeric_similarity(spark):
    def one(a, b, f):
        df = spark.createDataFrame([(a, b)], "a double, b double")
        return df.select(numeric_similarity(F.col("a"), F.col("b"), f)).first()[0]

    assert one(3.0, 4.0, "bedrooms") == 0.0
    assert one(1.0, 2.0, "bathrooms") == 1.0
    assert one(1000.0, 1090.0, "square_feet") == 1.0
    assert one(1000.0, 2000.0, "square_feet") == pytest.approx(1 - (0.5 - 0.1) / 0.9)
    assert one(0.0, 0.0, "square_feet") == 1.0
    assert one(None, 1.0, "square_feet") is None


def test_tag_keys(spark):
    df = spark.sql("select map('b', '2', 'a', '1') t union all select map() union all select null")
    got = {r[0] for r in df.select(metrics.tag_key(F.lit("m"), F.col("t").cast("map<string,string>"))).collect()}
    assert got == {"m|a=1,b=2", "m"}
    assert apply(spark, metrics.parse_tags, ["a=1,b=x=y", "a=1,a=2,zz", ""]) == [
        {"a": "1", "b": "x=y"}, {"a": "2"}, {}]


def test_score_pairs_is_order_dependent(spark):
    base = "city string, state string, zip_code string, bedrooms double, bathrooms double, square_feet double"
    row = (None, None, None, None, None, None)
    a = spark.createDataFrame([("tide", *row), ("diet", *row)], "street_address string, " + base)
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns])
    right = a.select(*[F.col(c).alias(f"b_{c}") for c in a.columns])
    pairs = left.join(right, F.col("a_street_address") != F.col("b_street_address"))
    got = {r["a_street_address"]: r["similarity"] for r in score_pairs(pairs).collect()}
    assert got == {"tide": 0.25, "diet": 0.5}
