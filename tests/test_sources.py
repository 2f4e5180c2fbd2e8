"""Page extraction, responses and file round trips on small hand-made inputs."""

import csv
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from homeledger.schema import schema_of
from homeledger.sinks import files as sinks
from homeledger.sinks import fingerprints
from homeledger.sources import files, records, responses, sites
from homeledger.sources.html import Pick, parse, pick, select_fields
from homeledger.sources.registry import Sources, cap_per_search

PAGE = "page_id bigint, url string, html string"


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(htmls)], PAGE)


@pytest.mark.parametrize("selector, want", [
    ("p", "one"), (".b", "two"), ("p.b", "two"), ("div p", "two"), ("[data-k]", "two"),
    ('[data-k="v1"]', "two"), ('a[href*="/home/"]', "link"), (".zz, .b", "two"), ("div .b i", None),
])
def test_selectors(selector, want):
    root = parse('<p>one</p><div><p class="a b" data-k="v1"> two <!-- no --></p>'
                 '<a href="/home/1">link<br></a></div>')
    assert pick(root, Pick(selector)) == want


def test_text_skips_scripts_and_joins_stripped_parts():
    root = parse("<div> a <b> b </b>\n<script>var x;</script> c &amp; d</div>")
    assert pick(root, Pick("div")) == "abc & d"
    assert pick(root, Pick("script")) == "var x;"


def test_unclosed_tags_and_empty_pages(spark):
    df = select_fields(pages(spark, "<ul><li>a<li>b</ul><p>after", "", None), {
        "items": Pick("li", every=True), "after": Pick("p")})
    rows = df.orderBy("page_id").collect()
    assert rows[0]["items"] == ["ab", "b"] and rows[0]["after"] == "after"
    assert rows[1]["items"] == [] and rows[2]["after"] is None


def test_zillow_cards(spark):
    full = (
        '<div class="list-card-info"><a href="/homedetails/x/77_zpid/">l</a>'
        '<div class="list-card-price">$500,000+</div><div class="list-card-addr">1 A St, Town, CA 90210</div>'
        '<div class="list-card-details">3 bds2 ba, sqft</div><div class="list-card-status">Pending</div>'
        '<div class="list-card-img"><img data-src="i.jpg"></div></div>')
    no_id = '<div class="list-card-info"><a href="/homedetails/x/">l</a></div>'
    fallback = '<div class="list-card"><a href="https://z.example/homedetails/8_zpid/">l</a></div>'
    rows = sites.zillow_cards(pages(spark, full + no_id, fallback, "<p>none</p>")).orderBy("page_id").collect()
    assert [r["external_id"] for r in rows] == ["77", "8"]
    a = rows[0]
    assert (a["price"], a["city"], a["state"], a["zip_code"]) == (500000.0, "Town", "CA", "90210")
    assert (a["bedrooms"], a["bathrooms"], a["square_feet"]) == (3, 2.0, None)
    assert (a["property_type"], a["listing_status"], a["images"]) == (1, "pending", ["i.jpg"])
    assert a["listing_url"] == "https://www.zillow.com/homedetails/x/77_zpid/"
    assert rows[1]["listing_status"] == "active" and rows[1]["images"] is None


def test_apartments_cards(spark):
    a = ('<div class="placard"><a class="property-link" href="/p/55/">x</a>'
         '<i class="rent-range">$1,200 - $1,800</i><i class="bed-bath">Studio, 1 Bath</i>'
         '<i class="amenities">Pool, Fitness</i><i class="availability">Not available</i></div>')
    no_link = '<div class="placard" data-listingid="q"><b class="property-name">N</b></div>'
    by_attr = '<section data-propertyid="P9"><a class="property-link" href="/p/x">x</a></section>'
    rows = sites.apartments_cards(pages(spark, a + no_link, by_attr)).orderBy("page_id").collect()
    assert [r["external_id"] for r in rows] == ["55", "P9"]
    r = rows[0]
    assert (r["price"], r["rent_estimate"], r["bedrooms"], r["bathrooms"]) == (1500.0, 1500.0, 0, 1.0)
    assert r["features"] == {"pool": "true", "gym": "true"} and r["pool"] and r["available_now"]
    assert rows[1]["features"] is None and rows[1]["pool"] is None


def test_apartments_detail_units(spark):
    unit = ('<div class="unit-card"><b class="unit-price">{}</b><b class="unit-bed-bath">{}</b>'
            '<b class="unit-sqft">{}</b></div>')
    html = unit.format("$1,000", "1 bd 1 ba", "500 sq") + unit.format("$2,000", "2 bd 1 ba", "801") + unit.format(
        "Call", "2 beds 2.5 ba", ",")
    a, b = sites.apartments_details(pages(spark, html, "<p>empty</p>")).orderBy("page_id").collect()
    assert (a["price"], a["min_rent"], a["max_rent"]) == (1500.0, 1000.0, 2000.0)
    assert (a["bedrooms"], a["min_bedrooms"], a["bathrooms"], a["square_feet"]) == (2, 1, 1.0, 650)
    assert b["price"] is None and b["bedrooms"] is None and b["images"] is None and b["amenities"] == []


LD = '<script type="application/ld+json">{}</script>'
PRODUCT = '{"@type": "Product", "description": "d", "offers": {"price": "$1,500"}}'


def test_json_ld_choices(spark):
    df = pages(
        spark,
        LD.format('{"@type": "Place"}') + LD.format("{bad") + LD.format(PRODUCT),
        LD.format("[" + PRODUCT + "]"),
        LD.format('{"@type": "Product", "offers": {"price": 1200}}'),
        "<p></p>",
    )
    first = [(r["has_ld"], r["ld_description"], r["ld_price"]) for r in
             responses.with_first_product(df).orderBy("page_id").collect()]
    assert first == [(True, "d", 1500.0), (False, None, None), (True, "", 1200.0), (False, None, None)]
    parsed = [(r["has_ld"], r["ld_description"], r["ld_price"]) for r in
              responses.with_first_parsed(df).orderBy("page_id").collect()]
    assert parsed == [(False, None, None), (True, "d", None), (True, "", 1200.0), (False, None, None)]


def test_responses(spark):
    df = spark.createDataFrame([
        (1, '{"homes": [{"property_id": 5, "property_type": 2, "price": 10, "pool": true, "photo_count": 1,'
            ' "photo_url": "u", "url": "/h"}, {}]}'), (2, '{"homes": []}'), (3, "{broken"), (4, None)],
        "page_id int, body string")
    a, b = responses.home_records(responses.homes(df)).orderBy("pos").collect()
    assert (a["external_id"], a["property_type"], a["images"]) == ("5", 3, ["u"])
    assert a["features"] == {"pool": "true"} and a["pool"] and a["listing_url"].endswith(".com/h")
    assert (b["external_id"], b["property_type"], b["images"], b["features"]) == ("", 1, [], {})
    api = spark.createDataFrame([(1, '{"properties": [{"city": "A"}]}'), (2, "{}")], "id int, body string")
    assert [r["city"] for r in responses.api_records(api).collect()] == ["A"]


def test_unknown_suffix_and_source_raise(spark):
    with pytest.raises(ValueError):
        files.read_file(spark, "x.xlsx")
    with pytest.raises(ValueError):
        Sources().extract({"nowhere": spark.range(1)})


def test_csv_and_json_round_trip(spark, scratch):
    df = spark.createDataFrame(
        [(1, "01234", ' a "q", b\nline ', None), (2, None, "", 1.5)], "id int, zip string, text string, x double")
    want = sorted(map(tuple, df.collect()))
    csv = sinks.save_csv(df, scratch, "out")
    assert csv.endswith("out.csv")
    # Empty text and null are the same empty cell in CSV.
    assert sorted(map(tuple, files.read_file(spark, csv, df.schema).collect())) == [
        want[0], (2, None, None, 1.5)]
    js = sinks.save_json(df, scratch, "out")
    assert sorted(map(tuple, files.read_json(spark, js, df.schema).collect())) == want


def test_append_keeps_versions_and_counts_given_rows(spark, scratch):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z"), (3, "z")], "id int, v string")
    path = f"{scratch}/rows"
    assert sinks.append_csv(a, path) == 2
    first = set(files.read_csv(spark, path, a.schema).inputFiles())
    assert sinks.append_csv(b, path) == 3
    stored = files.read_csv(spark, path, a.schema)
    assert stored.count() == 3 and first <= set(stored.inputFiles())
    assert sinks.append_csv(b, path) == 3 and files.read_csv(spark, path, a.schema).count() == 3
    sinks.append_csv(b, path, deduplicate=False)
    assert files.read_csv(spark, path, a.schema).count() == 6
    odd = spark.createDataFrame([(4, 'a\nb\\n\r"q"'), (4, 'a\nb\\n\r"q"'), (5, ""), (6, None)], "id int, v string")
    sinks.append_csv(odd, path)
    sinks.append_csv(odd, path)
    back = {tuple(r) for r in files.read_csv(spark, path, a.schema).filter("id > 3").collect()}
    assert back == {(4, 'a\nb\\n\r"q"'), (5, None), (6, None)}
    assert files.read_csv(spark, path, a.schema).count() == 9


def test_large_files_are_split(spark, scratch):
    df = spark.range(40_000).select("id", F.repeat(F.lit("text "), 10).alias("v")).coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        for rows in (
            files.read_csv(spark, sinks.save_csv(df, scratch, "big"), df.schema),
            files.read_json(spark, sinks.save_json(df, scratch, "big"), df.schema),
        ):
            tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
            assert tasks > 1 and rows.count() == 40_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


CELLS = ["", "plain", 'a "quoted" word', "line\nbreak", "two\n\nbreaks\n", "comma, comma", '"', '""', "C:\\new folder", "x" * 700,
         '12" pipe', "a\n\"b\",\n\"", ",", "é中\n😀", "\\", "tab\t", " outer "]


def test_quoted_line_breaks_over_byte_ranges(spark, scratch, small_ranges):
    """Files of others, as the standard writer leaves them, cut anywhere."""
    rng = random.Random(3)
    want = []
    os.makedirs(f"{scratch}/f.csv")
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        rows = [(str(1000 * k + i), rng.choice(CELLS), rng.choice(CELLS)) for i in range(120)]
        with open(f"{scratch}/f.csv/{k}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=end)
            writer.writerow(["id", "a", "b"])
            writer.writerows(rows)
        want += [(int(i), a or None, b or None) for i, a, b in rows]
    schema = files.T.StructType.fromDDL("id int, a string, b string")
    got = files.read_file(spark, f"{scratch}/f.csv", schema)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    text = records.lines(spark, f"{scratch}/f.csv")
    assert text.select("file", "start").distinct().count() > 20 and records.csv_breaks(text)
    with pytest.raises(ValueError, match="header"):
        files.read_csv(spark, f"{scratch}/f.csv", files.T.StructType.fromDDL("id int, a string, c string"))


def test_stray_quotes_are_no_line_breaks(spark, scratch):
    spark.createDataFrame([('id,v\n1,12" pipe\n2,6" pipe\n3,"a ""b"""',)], "value string").coalesce(1).write.text(f"{scratch}/f.csv")
    assert not records.csv_breaks(records.lines(spark, f"{scratch}/f.csv"))
    got = files.read_csv(spark, f"{scratch}/f.csv", files.T.StructType.fromDDL("id int, v string"))
    assert {tuple(r) for r in got.collect()} == {(1, '12" pipe'), (2, '6" pipe'), (3, 'a "b"')}


@pytest.mark.parametrize("indent", [None, 2, "\t"])
@pytest.mark.parametrize("shape", ["array", "objects", "arrays"])
def test_json_over_lines_and_byte_ranges(spark, scratch, small_ranges, indent, shape):
    rng = random.Random(4)
    rows = [{"id": i, "v": rng.choice(CELLS) + '}{][\\" ', "tags": [{"k": "]}"}] * rng.randrange(3)} for i in range(150)]
    os.makedirs(f"{scratch}/f.json")
    with open(f"{scratch}/f.json/a.json", "w") as out:
        if shape == "array":
            json.dump(rows, out, indent=indent, ensure_ascii=False)
        elif shape == "objects":
            out.write("\n".join(json.dumps(r, indent=indent) for r in rows))
        else:
            out.write("\n".join(json.dumps(rows[i : i + 7], indent=indent) for i in range(0, 150, 7)))
    schema = files.T.StructType.fromDDL("id int, v string, tags array<struct<k string>>")
    got = files.read_json(spark, f"{scratch}/f.json", schema, mode="FAILFAST")
    have = [{"id": r.id, "v": r.v, "tags": [{"k": t.k} for t in r.tags]} for r in got.collect()]
    assert sorted(have, key=lambda r: r["id"]) == rows
    if indent:
        assert records.lines(spark, f"{scratch}/f.json").select("start").distinct().count() > 20


def test_text_that_is_no_json(spark, scratch):
    spark.createDataFrame([('{"id": 1}\n{"id": \n',)], "value string").coalesce(1).write.text(f"{scratch}/f.json")
    schema = files.T.StructType.fromDDL("id int")
    assert sorted(r.id or 0 for r in files.read_json(spark, f"{scratch}/f.json", schema).collect()) == [0, 1]
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_json(spark, f"{scratch}/f.json", schema, mode="FAILFAST").collect()


def test_other_readers_get_the_same_text(spark, scratch):
    rows = [(i, c) for i, c in enumerate(CELLS) if c]
    df = spark.createDataFrame(rows, "id int, v string")
    folder = sinks.save_csv(df, scratch, "plain")
    found = []
    for name in glob.glob(f"{folder}/*.csv"):
        with open(name, newline="") as part:
            found += [(int(i), v) for i, v in list(csv.reader(part))[1:]]
    assert sorted(found) == rows
    lines = sinks.save_csv(df, scratch, "lines", one_line=True)
    assert not records.csv_breaks(records.lines(spark, lines))
    assert sorted(map(tuple, files.read_csv(spark, lines, df.schema, one_line=True).collect())) == rows


def test_job_output_and_typed_table(spark, scratch):
    df = spark.range(10).select((F.col("id") % 2).cast("string").alias("job_id"), "id",
                                F.array(F.lit("a")).alias("images"))
    assert sinks.save_job_csv(df, f"{scratch}/jobs") == 10
    stored = sinks.save_table(df.select(F.col("id").alias("property_id")), f"{scratch}/t", "properties")
    assert stored.schema == schema_of("properties") and stored.count() == 10


def test_fingerprint_state(spark, scratch):
    path = f"{scratch}/state"
    assert fingerprints.load(spark, path).count() == 0
    one = spark.createDataFrame([("a",), ("b",), ("a",)], "fp string")
    fingerprints.append(one, path)
    fingerprints.append(one.unionAll(spark.createDataFrame([("c",)], "fp string")), path)
    assert sorted(r[0] for r in fingerprints.load(spark, path).collect()) == ["a", "b", "c"]


def test_cap_per_search(spark):
    df = spark.range(3000).select(F.lit("j").alias("job_id"), (F.col("id") / 350).cast("int").alias("page"),
                                  F.col("id").alias("pos"))
    assert cap_per_search(df, 1000).agg(F.count("*"), F.max("pos")).first()[:] == (1000, 999)
    assert cap_per_search(df, cap=2000).agg(F.count("*"), F.max("pos")).first()[:] == (2000, 1999)


def test_deep_pages_are_read(spark):
    deep = "<div class='c'>" + "<p>x" * 5000 + "<b class='n'>end</b></div><div class='c'><i class='n'>two</i></div>"
    pages = spark.createDataFrame([(1, deep), (2, "<div class='c'><b class='n'>y</b></div>")], "page_id int, html string")
    spec = {"all": Pick(), "n": Pick(".n"), "both": Pick("b, i", every=True)}
    got = {(r.page_id, r.pos): (len(r["all"]), r.n, r.both) for r in select_fields(pages, spec, (".c",)).collect()}
    assert got[(1, 0)][0] == 5000 + len("end") + len("two") or got[(1, 0)][0] == 5000 + len("end")
    assert got[(1, 0)][1] == "end" and got[(2, 0)] == (1, "y", ["y"])


def test_script_type_in_any_quotes(spark):
    body = '{"@type": "Product", "description": "d", "offers": {"price": 5}}'
    kinds = ['type="application/ld+json"', "type='application/ld+json'", "type=application/ld+json", "id=x type = 'application/ld+json' a"]
    pages = spark.createDataFrame([(i, f"<script {k}>{body}</script>") for i, k in enumerate(kinds)], "page_id int, html string")
    scripts = pages.select("page_id", F.regexp_extract("html", responses.LD_SCRIPT, 1).alias("js"))
    assert {r.js for r in scripts.collect()} == {body} and scripts.count() == 4
    wrong = spark.createDataFrame([("<script type=application/ld+jsonx>a</script>",)], "html string")
    assert wrong.select(F.regexp_extract("html", responses.LD_SCRIPT, 1)).first()[0] == ""


def test_a_bad_page_fails_alone(spark):
    bad = "<div class='c'><b class='n'>lost</b></div><![foo[bar]]>"
    good = "<div class='c'><b class='n'>kept</b></div><div class='c'></div>"
    df = spark.createDataFrame([(1, bad), (2, good), (3, None)], "page_id int, html string")
    spec = {"n": Pick(".n"), "all": Pick("b", every=True)}
    cards = select_fields(df, spec, (".c",))
    assert sorted((r.page_id, r.pos, r.n) for r in cards.collect()) == [(2, 0, "kept"), (2, 1, None)]
    whole = {r.page_id: (r.n, r["all"]) for r in select_fields(df, spec).collect()}
    assert whole == {1: (None, None), 2: ("kept", ["kept"]), 3: (None, [])}
    # Counted, with the reason.
    told = select_fields(df, spec, (".c",), errors="error")
    failed = told.filter("error is not null").collect()
    assert [(r.page_id, r.pos, r.n) for r in failed] == [(1, None, None)] and "Error" in failed[0].error
    assert told.filter("error is null").count() == 2


def test_a_batch_reads_its_input_once(spark, scratch):
    from homeledger.plans import batch
    from homeledger.plans.fixtures import listings, orders_as_of

    sf = "/root/testdata/sf0.001"
    listings(spark, sf).write.parquet(f"{scratch}/in")
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(frame.num_rows)
            yield frame

    df = spark.read.parquet(f"{scratch}/in")
    got = batch.run(df.mapInArrow(count, df.schema), "j", orders_as_of(), f"{scratch}/out")
    assert seen.value == df.count() == got["total_input"]
    assert got["saved"] == got["processed"] == got["total_input"] - got["invalid"] - got["duplicates"] > 0


def test_plain_pages_are_read_as_the_parser_reads_them():
    import random

    from homeledger.sources import html

    def tree(page):
        return [(n.tag, n.attrs, n.classes, n.parent and n.parent.at, [c if isinstance(c, str) else c.at for c in n.children])
                for n in page]

    def parsed(text):
        t = html._Tree()
        t.feed(text)
        t.close()
        return t.page

    bits = ["<p>", "</p>", '<a href="/x?y=1" class="u v">', "</a>", "<br>", "<img src=\"q\">", "a &amp; b", "&ampx", " \n", "<LI>", "</li>",
            "<script>", "</script>", "<style>", "</style>", "x > y", "a < b", "<!-- c -->", "<!DOCTYPE html>", "<br/>", "<i b=c>", "<p",
            '<b t="a>b">', '<b t="&lt;">', "<b t='1'>", '<b T="1" t="2">', "</b >", "<textarea>", "é ", "<title>", "</title>", "&"]
    rnd = random.Random(3)
    plain = 0
    for _ in range(6000):
        text = "".join(rnd.choice(bits[:18] if rnd.random() < 0.7 else bits) for _ in range(rnd.randrange(9)))
        page = html._plain(text)
        if page is not None:
            plain += 1
            assert tree(page) == tree(parsed(text)), text
    assert plain > 1000


def test_listings_are_spread_over_all_cores(spark):
    from homeledger.plans.fixtures import listings

    assert listings(spark, "/root/testdata/sf0.001").select(F.spark_partition_id()).distinct().count() >= 8


def test_rows_of_plain_pages_equal_those_picked_from_the_tree():
    import random

    from homeledger.sources import html

    unit = (("n", Pick("b")), ("all", Pick("b, i", every=True)), ("own", Pick("", ("id", "k"))))
    spec = {
        "first": Pick("i"), "below": Pick(".c b"), "link": Pick('a[href*="/h"]', ("k", "href")), "own": Pick("", ("id",)), "text": Pick(""),
        "alls": Pick("b, .d", every=True), "ids": Pick("[id]", ("id",), every=True), "units": Pick(".u, .d", each=unit),
    }
    bits = ['<div class="c">', '<div class="d c">', '<div class="u" id="1">', '<p id="">', '<p k="2" id="3">', "</div>", "</p>", "</x>", "<b>", "</b>", "<i>",
            "</i>", '<a href="/h/1">', '<a href="/h/2" k="x">', '<a href="/g">', "</a>", '<img class="d" id="4">', "<br>", " t ", "a &amp; b", "<script>",
            "</script>", "<style>", "</style>", "x > y", "<b class='d'>", '<p id="a>b">', '<p id="&lt;">', "<!-- c -->", "<p", "é"]
    rnd = random.Random(5)
    readers, fast = {}, 0
    for _ in range(8000):
        text = "".join(rnd.choice(bits[:24] if rnd.random() < 0.97 else bits) for _ in range(rnd.randrange(14)))
        for cards in ((), (".c", "p"), (".none", ".c .d, .u")):
            root = html._linked(html._parsed(text))
            found = html._cards(root, cards) if cards else [root]
            want = [{n: pick(card, p) for n, p in spec.items()} for card in found]
            kept = readers.setdefault(cards, [])
            assert html._rows(text, spec, cards, kept) == (want, None), (text, cards)
            fast += html._read(text, kept) is not None
    assert fast > 8000
    # Nothing is built for plain pages, and cards of the same tags share their plan.
    card = '<div class="c"><i>{0}</i><a href="/h/{0}">x</a></div>'
    page = "<body>" + "".join(card.format(i) for i in range(500)) + "</body>"
    kept = []
    rows, _ = html._rows(page, spec, (".c",), kept)
    assert [(r["first"], r["link"]) for r in rows] == [(str(i), f"/h/{i}") for i in range(500)]
    assert len(kept[0].plans) == 3 and kept[0].paths < 10


def test_pages_are_dealt_once_and_never_shuffled(spark):
    from homeledger.catalog.extraction import _zillow_search

    plan = _zillow_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange" in x and "Broadcast" not in x]
    assert len([x for x in dealt if "page_id" in x]) == 1
    assert "RoundRobin" not in plan and "ingest_seq" not in "".join(dealt)
