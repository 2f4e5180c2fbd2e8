"""Records that reach over line breaks, found by many tasks of one file.

A file is read as lines, in the byte ranges Spark splits it into. Each range sums up how it changes what the
next one starts in (inside a quoted cell, or at which depth of brackets); the few sums of a file are put
together in order, and each range then cuts its own lines into records. Only what crosses an edge of a range,
a piece per range at most, is shuffled and joined up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homeledger.session import ship_package

# A quoted cell without its closing quote, whole cells, and the cells before the last one of a line.
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_CELLS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
# Lines that end in an open quote: from outside, and from inside one.
OPENS = rf'{_CELLS}"{_INSIDE}'
STAYS_OPEN = rf'{_INSIDE}(?:"[^,]*+,{_CELLS}"{_INSIDE})?+'
_opens, _stays_open = re.compile(OPENS), re.compile(STAYS_OPEN)
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]', re.DOTALL)
_KEYS = ["file", "start"]
BLANKS = " \t\r\ufeff"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, file, start`` and the folder columns: each line, without its ``\\n``, and its byte range."""
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.withColumns({"file": F.col("_metadata.file_path"), "start": F.col("_metadata.file_block_start")})


def csv_breaks(text: DataFrame) -> bool:
    """Whether a quoted cell goes on over a line break (an action, one native pass)."""
    return not text.filter(F.col("value").rlike(f"^(?:{OPENS})$")).isEmpty()


def _plain(value: Column) -> Column:
    """A line of JSON without its strings."""
    bare = F.replace(F.replace(value, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    return F.regexp_replace(bare, '"[^"]*"', "")


def _depth(value: Column) -> Column:
    """Brackets that a line of JSON opens, less those it closes."""
    bare = _plain(value)
    count = lambda letters: F.char_length(F.translate(bare, letters, ""))
    return count("}]") - count("{[")


def json_breaks(text: DataFrame) -> bool:
    """Whether a line is anything but whole records or arrays of records (an action, one native pass)."""
    value = F.btrim(F.col("value"), F.lit(BLANKS))
    whole = (value == "") | (value.rlike(r"^[\[{]") & value.rlike(r"[\]}]$") & (_depth(F.col("value")) == 0))
    return not text.filter(~whole).isEmpty()


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str], bool, int]]:
    """The lines of a task, range by range: key, some lines, whether the range is new, the last batch's state."""
    last = None
    for batch in batches:
        rows = batch.to_pydict()
        at = 0
        while at < batch.num_rows:
            key = (rows["file"][at], rows["start"][at])
            end = at
            while end < batch.num_rows and rows["start"][end] == key[1] and rows["file"][end] == key[0]:
                end += 1
            yield key, rows["value"][at:end], key != last, rows["state"][at] if "state" in rows else 0
            last, at = key, end


def _quote_effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether it ends inside a quote, begun outside and begun inside one."""
    key, outside, inside = None, False, True

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"file": [key[0]], "start": pa.array([key[1]], pa.int64()), "outside": [outside], "inside": [inside]}
        )

    for found, values, new, _ in _ranges(batches):
        if new:
            if key is not None:
                yield row()
            key, outside, inside = found, False, True
        for value in values:
            if '"' in value:
                opens, stays = bool(_opens.fullmatch(value)), bool(_stays_open.fullmatch(value))
                outside, inside = (stays if outside else opens), (stays if inside else opens)
    if key is not None:
        yield row()


def _csv_states(text: DataFrame) -> DataFrame:
    """``file, start, state``: 1 where a byte range begins inside a quoted cell."""
    effects = text.select("value", *_KEYS).mapInArrow(
        _quote_effects, "file string, start long, outside boolean, inside boolean"
    )
    # A range that ends alike from either side fixes the state; later ones keep it or turn it over.
    fixes, turns = F.col("outside") == F.col("inside"), F.col("outside") & ~F.col("inside")
    in_order = Window.partitionBy("file").orderBy("start")
    counted = effects.withColumn("turns", F.sum(turns.cast("int")).over(in_order))
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(earlier)
    fixed = F.coalesce(last(F.when(fixes, F.col("outside").cast("int"))), F.lit(0))
    since = F.coalesce(last("turns"), F.lit(0)) - F.coalesce(last(F.when(fixes, F.col("turns"))), F.lit(0))
    return counted.select(*_KEYS, ((fixed + since) % 2).cast("int").alias("state"))


def _json_states(text: DataFrame) -> DataFrame:
    """``file, start, state``: twice the depth a byte range begins at, plus 1 where the file is an array."""
    letter = F.nullif(F.substring(F.btrim(F.col("value"), F.lit(BLANKS)), 1, 1), F.lit(""))
    place = F.when(letter.isNotNull(), F.col("place"))
    sums = text.withColumn("place", F.monotonically_increasing_id()).groupBy(*_KEYS).agg(
        F.sum(_depth(F.col("value"))).alias("depth"), F.min_by(letter, place).alias("opener")
    )
    in_order = Window.partitionBy("file").orderBy("start")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    depth = F.coalesce(F.sum("depth").over(earlier), F.lit(0))
    array = F.first("opener", ignorenulls=True).over(whole) == "["
    return sums.select(*_KEYS, (2 * depth + F.coalesce(array, F.lit(False)).cast("int")).cast("int").alias("state"))


PIECES = "file string, start long, kind int, record string, first boolean"
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    file, start, kind, record, first = zip(*rows) if rows else ((), (), (), (), ())
    return pa.RecordBatch.from_pydict({
        "file": pa.array(file, pa.string()), "start": pa.array(start, pa.int64()),
        "kind": pa.array(kind, pa.int32()), "record": pa.array(record, pa.string()),
        "first": pa.array(first, pa.bool_()),
    })


def _cut_csv(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to records; a range begun or ended inside a quote gives a piece of one."""
    key, held, open_, first, begun = None, [], False, True, False

    def close() -> list[tuple]:
        if not held:
            return []
        return [(*key, MIDDLE if first and begun else TAIL, "\n".join(held), first and not key[1])]

    for found, values, new, state in _ranges(batches):
        out = []
        if new:
            out += close()
            key, held, open_, first, begun = found, [], bool(state), True, bool(state)
        for value in values:
            held.append(value)
            if '"' in value:
                open_ = bool((_stays_open if open_ else _opens).fullmatch(value))
            if not open_:
                out.append((*key, HEAD if first and begun else WHOLE, "\n".join(held), first and not key[1]))
                held, first = [], False
        if out:
            yield _pieces(out)
    yield _pieces(close())


def _cut_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to the objects that stand at the top, or in an array at the top."""
    key, held, depth, base, first, begun = None, [], 0, 0, True, False

    def close() -> list[tuple]:
        return [(*key, MIDDLE if first and begun else TAIL, "\n".join(held), False)] if held else []

    for found, values, new, state in _ranges(batches):
        out = []
        if new:
            out += close()
            key, held, first = found, [], True
            depth, base = state >> 1, state & 1
            begun = depth > base
        for value in values:
            at = 0 if depth > base else None
            for token in _TOKEN.finditer(value):
                t = token[0]
                if t in "{[":
                    if depth == base and t == "{":
                        at = token.start()
                    depth += 1
                elif t in "}]":
                    depth -= 1
                    if depth == base and at is not None:
                        held.append(value[at : token.end()])
                        out.append((*key, HEAD if first and begun else WHOLE, "\n".join(held), False))
                        held, at, first = [], None, False
            if at is not None:
                held.append(value[at:])
        if out:
            yield _pieces(out)
    yield _pieces(close())


def _joined(pieces: DataFrame) -> DataFrame:
    """``file, record, first``: whole records, and those put together from a tail, middles and a head."""
    parts = pieces.filter(F.col("kind") != WHOLE)
    # A record is named by the range it begins in; a range has at most one head and one tail.
    rank = F.when(F.col("kind") == HEAD, 0).when(F.col("kind") == MIDDLE, 1).otherwise(2)
    so_far = Window.partitionBy("file").orderBy("start", rank).rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max(F.when(F.col("kind") == TAIL, F.col("start"))).over(so_far)
    whole = parts.withColumn("begun", begun).groupBy("file", "begun").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p.record), "\n"
        ).alias("record"),
        F.max("first").alias("first"),
    )
    return pieces.filter(F.col("kind") == WHOLE).select("file", "record", "first").union(
        whole.select("file", "record", "first")
    )


def _cut(text: DataFrame, states: DataFrame, cutter) -> DataFrame:
    """Records with the folder columns of their files."""
    ship_package(text.sparkSession)
    folders = [c for c in text.columns if c not in ("value", *_KEYS)]
    # One row per byte range of the input.
    given = text.join(F.broadcast(states), _KEYS)
    records = _joined(given.select("value", *_KEYS, "state").mapInArrow(cutter, PIECES))
    if folders:
        records = records.join(F.broadcast(text.select("file", *folders).distinct()), "file")
    return records


def csv_records(text: DataFrame) -> DataFrame:
    """``file, record, first`` of CSV text: records end where a line does outside of quotes; ``first`` of a file."""
    return _cut(text, _csv_states(text), _cut_csv)


def json_records(text: DataFrame) -> DataFrame:
    """``file, record`` of JSON text: every object at the top level or in a top-level array."""
    return _cut(text, _json_states(text), _cut_json)
