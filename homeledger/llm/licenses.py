"""License scan: ordered signature rules, gated by keywords, with overlapping finds resolved."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from homeledger.llm.text import row_key
from homeledger.session import materialize

# Phrases whose every place counts, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN = 12  # words looked at on either side of an anchor; no rule reaches further

# Families: label, the names before the word "license", SPDX id in words, keyword, versions in words.
FAMILIES = (
    ("mit", "mit|expat", "mit", "mit", ()),
    ("apache", "apache|apache software", "apache", "apache", ("2 0", "2", "1 1", "1 0")),
    ("gpl", "gnu general public|gnu gpl|gpl|general public", "gpl", "g", ("3 0", "3", "2 0", "2", "1 0", "1")),
    ("lgpl", "gnu lesser general public|lesser general public|gnu lgpl|lgpl", "lgpl", "l", ("3 0", "3", "2 1", "2 0", "2")),
    ("agpl", "gnu affero general public|affero general public|gnu agpl|agpl", "agpl", "a", ("3 0", "3", "1 0")),
    ("bsd", "bsd|berkeley software distribution|new bsd|simplified bsd|modified bsd", "bsd", "b", ()),
    ("mpl", "mozilla public|mpl", "mpl", "m", ("2 0", "2", "1 1", "1 0")),
    ("epl", "eclipse public|epl", "epl", "e", ("2 0", "2", "1 0")),
    ("cddl", "common development and distribution|cddl", "cddl", "d", ("1 1", "1 0")),
    ("eupl", "european union public|eupl", "eupl", "eu", ("1 2", "1 1")),
    ("isc", "isc|internet systems consortium", "isc", "is", ()),
    ("zlib", "zlib|zlib libpng", "zlib", "zlib", ()),
    ("artistic", "artistic|perl artistic", "artistic", "artistic", ("2 0", "2", "1 0")),
    ("boost", "boost software|boost", "bsl", "boost", ("1 0",)),
    ("ofl", "sil open font|open font|ofl", "ofl", "o", ("1 1",)),
    ("odbl", "open database|odbl", "odbl", "o", ("1 0",)),
    ("ms-pl", "microsoft public|ms pl", "ms pl", "m", ()),
    ("unlicense", "unlicense|the unlicense", "unlicense", "unlicense", ()),
    ("wtfpl", "wtfpl|do what the fuck you want to public", "wtfpl", "w", ("2",)),
    ("psf", "python software foundation|psf|python", "psf", "p", ("2 0", "2")),
    ("php", "php", "php", "php", ("3 01", "3 0")),
    ("postgresql", "postgresql", "postgresql", "postgresql", ()),
    ("osl", "open software|osl", "osl", "o", ("3 0", "2 1")),
    ("afl", "academic free|afl", "afl", "a", ("3 0", "2 1")),
    ("cecill", "cecill|cea cnrs inria logiciel libre", "cecill", "ce", ("2 1", "2 0", "1 1")),
    ("zpl", "zope public|zpl", "zpl", "z", ("2 1", "2 0")),
    ("ncsa", "university of illinois ncsa open source|ncsa", "ncsa", "ncsa", ()),
    ("vim", "vim", "vim", "vim", ()),
    ("ruby", "ruby", "ruby", "ruby", ()),
    ("w3c", "w3c|w3c software", "w3c", "w3c", ()),
    ("0bsd", "0bsd|zero clause bsd|bsd zero clause", "0bsd", "bsd", ()),
    ("x11", "x11", "x11", "x11", ()),
    ("busl", "business source", "busl", "bus", ("1 1",)),
    ("elastic", "elastic", "elastic", "elastic", ("2 0", "2", "1 0")),
    ("sspl", "server side public|sspl", "sspl", "s", ("1 0", "1")),
)
CC_PARTS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no derivatives|attribution no ?derivs"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
)
VERSION = "(?:version |ver |v ?|version v ?)?"
NOUNS = ("license", "licence", "licenses", "licences")
GRANTED_UNDER = "(?:released|distributed|available|provided|published|covered|licen[cs]ed) under (?:the )?(?:terms of )?(?:the )?"
# Bodies and headers that need not name a license: label, anchor, keyword, before, after.
BODIES = (
    ("mit", "granted", "charge", "permission is hereby", "free of charge to any person obtaining a copy"),
    ("boost", "granted", "organization", "permission is hereby", "free of charge to any person or organization"),
    ("isc", "granted", "fee", "this software for any purpose with or without fee is hereby", ""),
    ("bsd", "redistribution", "binary", "", "and use in source and binary forms"),
    ("zlib", "warranty", "provided", "this software is provided as is without any express or implied", ""),
    ("unlicense", "unencumbered", "software", "this is free and", "software released into the public domain"),
    ("wtfpl", "fuck", "want", "you just do what the", "you want to"),
)
# Names that are words of their own after "released under"; those of SURE mean a license anywhere.
BARE = {"mit": "mit", "apache": "apache", "bsd": "bsd", "isc": "isc", "zlib": "zlib", "unlicense": "unlicense"}
SURE = {"gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "cddl": "cddl", "eupl": "eupl",
        "wtfpl": "wtfpl"}
# Short names of other things too: without a full version they count near a license word only.
SHARED = ("mpl", "epl")
SURE_WORDS = {
    f"{word}{v}{version[0]}" if version else word: word
    for label, word in SURE.items() for version in ("", *{f[0]: f[4] for f in FAMILIES}[label]) for v in ("v", "")
}
ANCHORS = (
    *NOUNS, "licensed", "spdx", "cc", "creative", "cc0", "unlicense", *sorted({b[1] for b in BODIES}),
    *sorted({*BARE.values(), *SURE_WORDS} - {"unlicense"}),
)
RULE = "rule int, priority int, anchor string, keyword string, before string, after string, label string, score double"


def rules() -> list[tuple]:
    """The signatures in order: a lower priority number wins over the finds it contains.

    Each is a regular expression around an anchor word: ``before`` must match up to it,
    ``after`` from it on. ``keyword`` must occur near the anchor for them to be tried.
    """
    out: list[tuple] = []

    def add(priority, anchor, keyword, before, after, label, score):
        out.append((len(out), priority, anchor, keyword, before, after, label, score))

    for label, names, spdx, keyword, versions in FAMILIES:
        name = f"(?:{names})"
        for version in (*versions, None):
            full = label if version is None else f"{label}-{version.replace(' ', '.').removesuffix('.0')}"
            tail = "" if version is None else f" {VERSION}{version}"
            rank = 1 if version is None else 0
            add(10 + rank, "spdx", keyword, "", f"licen[cs]e identifier {spdx}{tail}", full, 1.0)
            add(20 + rank, "licensed", keyword, "",
                f"under (?:the )?(?:terms of )?(?:the )?{name}(?: public)?(?: licen[cs]e)?{tail.replace(' ', ',? ', 1) or ''}",
                full, 0.95)
            named = name if version is None else f"{name} ?{VERSION}{version}"
            for anchor in NOUNS:
                add(30 + rank, anchor, keyword, f"{GRANTED_UNDER}{name}", tail.strip(), full, 0.95)
                add(40 + rank, anchor, keyword, name, tail.strip(), full, 0.8)
                if version is not None:
                    add(30, anchor, keyword, f"{GRANTED_UNDER}{named}", "", full, 0.95)
                    add(40, anchor, keyword, named, "", full, 0.8)
            add(40 + rank, "licensed", keyword, named, "", full, 0.8)
            if label in BARE:
                add(50 + rank, BARE[label], "under", GRANTED_UNDER.replace("under ", "under").replace("(?:the )?", "(?: the)?").replace("(?:terms of )?", "(?: terms of)?"),
                    tail.strip(), full, 0.8)
            if label in SURE:
                near = "licen" if label in SHARED and " " not in (version or "") else ""
                add(60 + rank, SURE[label], near, "", tail.strip(), full, 0.6)
                if version is not None:
                    for v in ("v", ""):
                        add(60, f"{SURE[label]}{v}{version[0]}", near, "", version[2:], full, 0.6)
    for label, short, long in CC_PARTS:
        for version in ("4 0", "3 0", "2 5", "2 0", None):
            full = label if version is None else f"{label}-{version.replace(' ', '.')}"
            tail = "" if version is None else f" {VERSION}{version}"
            rank = (1 if version is None else 0) + 2 * (6 - len(label.split("-")))
            add(10 + rank, "spdx", "cc", "", f"licen[cs]e identifier cc {short}{tail}", full, 1.0)
            # "cc by" alone is ordinary language, too.
            add(20 + rank, "cc", "by" if tail or short != "by" else "licen", "", f"{short}{tail}", full, 0.9)
            add(20 + rank, "creative", "commons", "", f"commons (?:{long})(?: international| unported| generic)?"
                f"(?: public)?(?: licen[cs]e)?{tail}", full, 0.9)
    add(20, "cc0", "", "", "", "cc0", 0.9)
    add(20, "creative", "zero", "", "commons (?:cc0|zero)", "cc0", 0.9)
    add(30, "unlicense", "", "(?:under|the)(?: the)?", "", "unlicense", 0.7)
    for label, count in (("bsd-2-clause", "2|two"), ("bsd-3-clause", "3|three"), ("bsd-4-clause", "4|four")):
        for anchor in NOUNS:
            # With the words that lead in, so that a find of the bare name lies within.
            add(15, anchor, "clause", f"(?:{GRANTED_UNDER})?(?:(?:{count}) clause bsd|bsd (?:{count}) clause)", "", label, 0.95)
    for label, anchor, keyword, before, after in BODIES:
        add(25, anchor, keyword, before, after, label, 0.9)
    return out


def _words_before(s: Column) -> Column:
    return F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit("")))


def _base(low: Column, norm: Column) -> list[Column]:
    """Counts, first and last places and labels of the fixed phrases in ``norm`` (null: no phrase)."""
    counts, first, last, labels = [], [], [], []
    for phrase, label in PHRASES:
        padded, mirrored = f" {phrase} ", f" {phrase} "[::-1]
        has = F.contains(norm, F.lit(padded))
        counts.append(F.when(has, F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))).otherwise(0))
        at = F.instr(norm, padded)
        first.append(F.when(has, _words_before(F.substring(norm, F.lit(1), at)) - 1))
        end = F.char_length(norm) - F.instr(F.reverse(norm), mirrored) - len(padded) + 2
        last.append(F.when(has, _words_before(F.substring(norm, F.lit(1), end)) - 1))
        labels.append(F.when(has, F.lit(label)))
    return [
        F.coalesce(reduce(lambda a, b: a + b, counts), F.lit(0)).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"),
        F.greatest(*last).cast("long").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
    ]


def _normal(low: Column) -> Column:
    """The words of a lower-cased text, with one space between them and at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NOT_WORD, " ")), F.lit(" "))


def detections(docs: DataFrame) -> DataFrame:
    """Finds of the rules that no better one contains: ``key, start, end, label, score``.

    Only texts with an anchor word are split into words, and only anchor words become rows, each with
    ``SPAN`` words on either side; they meet the rules of their anchor. A find is suppressed
    by one that contains it and has a lower priority number, or the same and is longer. Places are
    words from 0, ends exclusive. Equal documents share their finds.
    """
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(rules(), RULE)
    low = docs.select(row_key().alias("key"), F.lower(F.col("text").cast("string")).alias("low"))
    gate = F.contains("low", F.lit("licen")) | F.contains("low", F.lit("spdx")) | F.contains("low", F.lit("creative"))
    gate = gate | F.contains("low", F.lit("unlicense")) | (F.contains("low", F.lit("cc")) & F.col("low").rlike(r"\bcc(?:0\b|\W+by\b)"))
    for word in sorted({*SURE.values(), *(b[1] for b in BODIES)}):
        gate = gate | F.contains("low", F.lit(word))
    bare = r"\bunder\W+(?:(?:the|terms|of)\W+){0,4}(?:" + "|".join(BARE.values()) + r")\b"
    gate = gate | (F.contains("low", F.lit("under")) & F.col("low").rlike(bare))
    words = low.filter(gate).select("key", F.split(F.trim(F.regexp_replace("low", NOT_WORD, " ")), " ").alias("w"))
    places = F.filter(
        F.transform("w", lambda w, i: F.struct(w.alias("anchor"), i.alias("at"))), lambda x: x.anchor.isin(*ANCHORS)
    )
    # Names that are common words too ("mit") count shortly after "under" only.
    places = F.filter(places, lambda x: ~x.anchor.isin(*BARE.values()) | (x.anchor == "unlicense") | F.array_contains(
        F.slice("w", F.greatest(x["at"] - 5, F.lit(0)) + 1, F.least(x["at"], F.lit(5))), "under"
    ))
    hits = words.select("key", "w", places.alias("p")).filter(F.size("p") > 0).select(
        "key",
        F.inline(F.transform("p", lambda x: F.struct(
            x.anchor.alias("anchor"),
            x.at.alias("at"),
            F.array_join(F.slice("w", F.greatest(x.at - SPAN, F.lit(0)) + 1, F.least(x.at, F.lit(SPAN))), " ").alias("left"),
            F.array_join(F.slice("w", x.at + 2, SPAN), " ").alias("right"),
        ))),
    )
    # The rules are the small side by construction; their anchors are few, and common ones hot.
    near = hits.join(F.broadcast(table), "anchor").filter(
        F.contains("left", F.col("keyword")) | F.contains("right", F.col("keyword"))
    )

    def match(side: str, rule: str, start: str, end: str) -> Column:
        """What a rule finds on one side of the anchor: empty if it asks for nothing, else null."""
        pattern = F.concat(F.lit(f"{start}(?:"), F.col(rule), F.lit(f"){end}"))
        return F.when(F.col(rule) == "", "").otherwise(F.trim(F.regexp_substr(side, pattern)))

    left, right = match("left", "before", "(?:^| )", "$"), match("right", "after", "^", "(?: |$)")
    found = (
        near.select("key", "rule", "priority", "label", "score", "at", left.alias("l"), right.alias("r"))
        .filter(F.col("l").isNotNull() & F.col("r").isNotNull())
        .select(
            "key", "rule", "priority", "label", "score",
            (F.col("at") - F.when(F.col("l") == "", 0).otherwise(_words_before(F.col("l")) + 1)).alias("start"),
            (F.col("at") + 1 + F.when(F.col("r") == "", 0).otherwise(_words_before(F.col("r")) + 1)).alias("end"),
        )
        .distinct()
    )
    around = Window.partitionBy("key").orderBy("start").rangeBetween(-2 * SPAN, 0)
    order = F.struct("priority", (F.col("start") - F.col("end")).alias("size"), "rule")
    rivals = F.collect_list(F.struct(order.alias("o"), "end")).over(around)
    beaten = F.exists("rivals", lambda r: (r.end >= F.col("end")) & (r.o < F.col("o")))
    return (
        found.withColumn("o", order).withColumn("rivals", rivals).filter(~beaten)
        .select("key", "start", "end", "label", "score")
    )


def scan(docs: DataFrame) -> DataFrame:
    """License finds of every document: fixed phrases and the ordered rules.

    ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_found``:
    ``labels`` joins the phrases' labels and those of the rules' finds; the score is that of the
    best rule (0.9 for a phrase), 0 if there is nothing. Words are runs of ASCII letters and digits and of
    all characters beyond ASCII. Null and empty texts have no words; very long ones are scanned whole. Repeated rows give a row
    each, an empty table none; only ``doc_id`` and ``text`` are read.
    """
    found = detections(docs).groupBy("key").agg(
        F.collect_set("label").alias("found"), F.max("score").alias("best"), F.count("*").alias("n_found")
    )
    found = materialize(found, "license-finds")
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("low", F.lower("text"))
    has = {w: F.contains("low", F.lit(w)) for phrase, _ in PHRASES for w in phrase.split()}
    gate = reduce(
        lambda a, b: a | b,
        [reduce(lambda a, b: a & b, [has[w] for w in sorted(set(p.split()), key=len, reverse=True)]) for p, _ in PHRASES],
    )
    based = text.select(
        "doc_id", "key", F.regexp_count("text", F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
        F.when(gate, _normal(F.col("low"))).alias("norm"),
    ).select("doc_id", "key", "n_words", *_base(F.col("norm"), F.col("norm")))
    labels = F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("base") > 0, 0.9).otherwise(0.0))
    return based.join(found, "key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        score.alias("score"),
        F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"),
    )
