"""Personal data: fixed patterns, and spans that weakly supervised labelers agree on."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeledger.session import materialize, ship_package

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "birth", "name", "local_phone")
LABELERS = ("form", "gazetteer", "context", "shape")
ACCEPT = 0.5
CONTEXT_CHARS = 48
PRIOR_VOTES = 10.0

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A digit run that fails fails from each of its digits, so only its start is tried, and it is
# never given back: long runs stay linear. The matches are those of the plain pattern.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Forms that only secrets have; a key block without its end is its header and the full lines after it.
KEY_BLOCK = r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY(?: BLOCK)?-----"
KNOWN = re.compile(
    r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}"
    r"|(?<![0-9A-Za-z_-])(?:sk|pk|rk)[-_][A-Za-z0-9_-]{20,}|(?<![0-9A-Za-z])xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|AIza[0-9A-Za-z_-]{35}|(?<![0-9A-Za-z_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"
    rf"|{KEY_BLOCK}(?:[^-]|-(?!----))*+{KEY_BLOCK.replace('BEGIN', 'END')}|{KEY_BLOCK}(?:\s{{1,2}}[A-Za-z0-9+/=]{{40,}})*+"
)
# What one of the known forms cannot do without.
KNOWN_PARTS = (
    "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "sk-", "sk_", "pk-", "pk_", "rk-", "rk_",
    "xox", "AIza", "eyJ", "-----BEGIN",
)
HEX_RUN = b"1" * 32
HEX_MARKS = bytes(49 if chr(c) in "0123456789abcdefABCDEF" else 48 for c in range(256))
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-Fa-f]{32,64})(?![0-9A-Za-z])")
# What a text itself calls a key or a password.
SECRET_WORDS = ("key", "token", "secret", "passw", "pwd", "clave", "contrase", "mot de passe")
GIVEN = re.compile(
    r"(?:key|token|secret|(passw(?:or[dt]|d)|pwd|contraseña|mot de passe)|clave)s?[\"'`]?"
    r"(?:\s{0,3}(?::=|=>|[:=])\s{0,3}|\s{1,3}(?:is|was|ist|lautet|es|est)\s{1,3}|\s{1,3}(?=[\"'`]?\S*[0-9]))[\"'`]?"
    r"([^\s\"'`<>,;(){}\[\]]{6,})",
    re.IGNORECASE,
)
NUMBER_PART = re.compile(r"[0-9][ ()./-]{1,2}[0-9]")
NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9]++(?:[ ()./-]{1,2}[0-9]++){2,3}(?![0-9A-Za-z])")
SSN = re.compile(r"([0-9]{3})-([0-9]{2})-([0-9]{4})")
DATE = re.compile(r"([0-9]{1,2})[./]([0-9]{1,2})[./]([0-9]{4})|([0-9]{4})-([0-9]{2})-([0-9]{2})")
LOCAL_PHONE = re.compile(r"(?:\(([0-9]{3})\) |([0-9]{3})[ .-])[0-9]{3}[ .-][0-9]{4}")
NAME = re.compile(
    r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? [A-Z][a-zà-ÿ]+(?: [A-Z][a-zà-ÿ]+)?"
)
TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor")
OPAQUE = re.compile(r"[0-9]|[a-z][A-Z]")

# Gazetteer: fixed words of our own choice.
FIRST_NAMES = frozenset(
    "anna anne antonio carlos carmen charles claire david elizabeth emma hans heinrich isabel james jean john jose "
    "juan julia karl laura louis lucia maria marie martin mary michael paul peter pierre robert sarah sophie thomas "
    "josé lucía maría".split()
)
FULL_NAME = re.compile(
    rf"\b(?:{'|'.join(sorted(map(str.title, FIRST_NAMES), key=len, reverse=True))})"
    r"(?:[ -][A-ZÀ-Þ](?:\.|[a-zà-ÿ]+))?(?: (?:van|von|de|del|la|der|den|du))* [A-ZÀ-Þ][a-zà-ÿ]+(?:-[A-ZÀ-Þ][a-zà-ÿ]+)?"
)
GIVEN_NAMES = tuple(sorted(map(str.title, FIRST_NAMES)))
# Words that make a place of the first name before them.
PLACES = frozenset(
    "avenue bridge church college hospital hotel island lake park river road school square station street strasse "
    "straße tower university".split()
)
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us ca ch at it nl".split())
RESERVED_NETS = ("0.", "127.", "255.")
# Context: words shortly before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": r"mail|contact|write|correo|courriel",
    "ip": r"\bip\b|address|host|server|adresse",
    "card": r"card|visa|credit|tarjeta|carte|karte",
    "phone": r"phone|call|tel|fax|mobile|whatsapp",
    "secret": r"key|token|secret|password|passwort|clave|aws",
    "ssn": r"ssn|social|security|tax",
    "birth": r"born|birth|dob|geboren|naci|née?\b",
    "name": r"dear|contact|patient|client|signed",
    "local_phone": r"phone|call|tel|fax|mobile|whatsapp",
}
FOR = {kind: re.compile(words, re.IGNORECASE) for kind, words in FOR.items()}
AGAINST = re.compile(r"version|isbn|figure|chapter|page|commit|checksum|sha1|sha256|md5", re.IGNORECASE)

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the four fixed patterns, in code points, sorted."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            out.append((start, 0, done))
        at = text.find("@", max(at + 1, done))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _calendar(parts: tuple) -> bool:
    d, m, y = (parts[0], parts[1], parts[2]) if parts[0] else (parts[5], parts[4], parts[3])
    try:
        return 1900 <= date(int(y), int(m), int(d)).year <= 2025
    except ValueError:
        return False


def extra_spans(text: str) -> list[Span]:
    """Candidates of the other kinds, most of which some labeler has to speak for.

    A pattern runs only over texts that hold a fixed part of it.
    """
    out: list[Span] = []
    secrets: set[tuple[int, int]] = set()
    if any(part in text for part in KNOWN_PARTS):
        secrets |= {(m.start(), m.end()) for m in KNOWN.finditer(text) if OPAQUE.search(m[0])}
    if HEX_RUN in text.encode("utf-8", "replace").translate(HEX_MARKS):
        secrets |= {(m.start(), m.end()) for m in HEX.finditer(text)}
    low = text.lower()
    if any(word in low for word in SECRET_WORDS):
        for m in GIVEN.finditer(text):
            found = m[2].rstrip(".:!?")
            # A plain word is no secret, unless a password is set to it.
            if len(found) >= (8, 6)[bool(m[1])] and (OPAQUE.search(found) or m[1] and re.search("[:=]", m[0][: -len(m[2])])):
                secrets.add((m.start(2), m.start(2) + len(found)))
    out += [(a, 4, b) for a, b in sorted(secrets)]
    if NUMBER_PART.search(text):
        for m in NUMBER.finditer(text):
            for kind, form in ((5, SSN), (6, DATE), (8, LOCAL_PHONE)):
                if form.fullmatch(m[0]):
                    out.append((m.start(), kind, m.end()))
    titled = [m.span() for m in NAME.finditer(text)] if any(t in text for t in TITLES) else []
    ends = [b for _, b in titled]
    named = FULL_NAME.finditer(text) if any(n in text for n in GIVEN_NAMES) else ()
    for a, b in (m.span() for m in named):
        at = bisect_right(ends, a)  # the first titled name that ends behind its start
        if at == len(titled) or titled[at][0] >= b:
            out.append((a, 7, b))
    out += [(a, 7, b) for a, b in titled]
    return out


def votes(text: str, span: Span) -> list[int]:
    """Each labeler's vote on a candidate: 1 for, -1 against, 0 no opinion."""
    start, number, end = span
    kind, found = KINDS[number], text[start:end]
    before = text[max(0, start - CONTEXT_CHARS) : start]
    form = gazetteer = 0
    if kind == "email":
        form = 1 if len(found) <= 254 and ".." not in found else -1
        gazetteer = 1 if found.rpartition(".")[2].lower() in TOP_DOMAINS else 0
    elif kind == "ip":
        form, gazetteer = 1, -1 if found.startswith(RESERVED_NETS) else 0
    elif kind == "card":
        form, gazetteer = 1, 1 if found[0] in "3456" else -1
    elif kind in ("phone", "local_phone"):
        form = 1 if kind == "phone" else 0
    elif kind == "secret":
        # Bare hexadecimal strings may be checksums; what stands before them has to decide.
        gazetteer = form = 1 if KNOWN.match(found) else 0
    elif kind == "ssn":
        area, group, serial = SSN.fullmatch(found).groups()
        form = -1 if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000" else 1
    elif kind == "birth":
        form = 0 if _calendar(DATE.fullmatch(found).groups()) else -1
    elif kind == "name":
        if NAME.match(found):
            form, gazetteer = 1, 1 if found.split()[1].lower() in FIRST_NAMES else 0
        else:
            form = gazetteer = -1 if found.split()[-1].lower() in PLACES else 0
            gazetteer = gazetteer or 1
    context = -1 if AGAINST.search(before) else 1 if FOR[kind].search(before) else 0
    same = len(set(found) - set(" ().-")) <= 2
    return [form, gazetteer, context, -1 if same else 1 if kind == "card" or form and kind == "secret" else 0]


LENGTHS = (10, 14, 18, 24, 40)
FEATURES = len(KINDS) * 3 ** len(LABELERS) * (len(LENGTHS) + 1) * 3


def feature_code(text: str, span: Span, given: list[int]) -> int:
    """The classifier's features in one number: kind, votes, length class, what stands before."""
    start, code, end = span
    for vote in given:
        code = code * 3 + vote + 1
    code = code * (len(LENGTHS) + 1) + sum(end - start > n for n in LENGTHS)
    edge = 0 if start == 0 or text[start - 1].isspace() else 1 if text[start - 1].isalnum() else 2
    return code * 3 + edge


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (one column a labeler) and a 0/1 feature matrix of feature codes."""
    edge, rest = codes % 3, codes // 3
    length, rest = rest % (len(LENGTHS) + 1), rest // (len(LENGTHS) + 1)
    given = np.zeros((len(codes), len(LABELERS)), dtype=int)
    for i in reversed(range(len(LABELERS))):
        given[:, i], rest = rest % 3 - 1, rest // 3
    one = [np.eye(len(KINDS))[rest], np.eye(len(LENGTHS) + 1)[length], np.eye(3)[edge]]
    one += [np.eye(3)[given[:, i] + 1] for i in range(len(LABELERS))]
    return rest, given, np.hstack(one)


def reliabilities(kind: np.ndarray, given: np.ndarray, count: np.ndarray, rounds: int = 50):
    """Expectation-maximisation over vote patterns: posteriors, and each labeler's vote rates.

    Labelers are independent given the truth, and having no opinion says nothing; a kind has
    its own share of true spans. The start trusts the majority of the votes.
    ``rates[truth, labeler]`` is the share of votes for among its votes, with a prior of
    ``PRIOR_VOTES`` that are right four times in five.
    """
    posterior = 1 / (1 + np.exp(-1.5 * given.sum(axis=1)))
    rates = np.zeros((2, given.shape[1]))
    for _ in range(rounds):
        for truth, weight in enumerate((count * (1 - posterior), count * posterior)):
            votes_for = ((given == 1) * weight[:, None]).sum(axis=0) + PRIOR_VOTES * (0.2, 0.8)[truth]
            rates[truth] = votes_for / (((given != 0) * weight[:, None]).sum(axis=0) + PRIOR_VOTES)
        total = np.bincount(kind, count, len(KINDS)) + PRIOR_VOTES
        share = (np.bincount(kind, count * posterior, len(KINDS)) + PRIOR_VOTES / 2) / total
        odds = np.log(share[kind]) - np.log1p(-share[kind])
        odds += (given == 1) @ np.log(rates[1] / rates[0]) + (given == -1) @ np.log((1 - rates[1]) / (1 - rates[0]))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, rates


def train(x: np.ndarray, y: np.ndarray, count: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels, by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (count * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (count * (y - p)) - ridge * w
        )
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _candidates(texts: pa.Array) -> pa.Array:
    """Each text's candidates: start, kind number and end of each in turn, and their features."""
    spans, codes = [], []
    for value in texts:
        found, code = scan(value.as_py())
        spans.append([n for span in found for n in span])
        codes.append(code)
    return pa.StructArray.from_arrays(
        [pa.array(spans, pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int32()))], names=["spans", "codes"]
    )


def candidates(docs: DataFrame, keep: Column) -> DataFrame:
    """``keep``, and ``spans`` and ``codes`` of each document, stored: one pass over the texts (an action)."""
    ship_package(docs.sparkSession)
    judge = F.arrow_udf(_candidates, "spans array<bigint>, codes array<int>")
    found = docs.select(keep, judge(F.col("text").cast("string")).alias("found"))
    return materialize(found.select(found.columns[0], "found.spans", "found.codes"), "pii-candidates")


def scan(text: str | None) -> tuple[list[Span], list[int]]:
    if not text:
        return [], []
    found = sorted(base_spans(text) + extra_spans(text))
    return found, [feature_code(text, s, votes(text, s)) for s in found]


def fit(found: DataFrame) -> np.ndarray:
    """Probability of a true span for every feature code, learned from all candidates (an action).

    Only counts per feature code reach the driver: at most ``FEATURES`` rows.
    """
    counts = found.select(F.explode("codes").alias("code")).groupBy("code").count().collect()
    codes = np.array([r.code for r in counts], dtype=np.int64)
    count = np.array([r["count"] for r in counts], dtype=float)
    kind, given, x = decode(codes)
    posterior, _ = reliabilities(kind, given, count)
    w = train(x, posterior, count) if len(codes) else np.zeros(x.shape[1])
    return 1 / (1 + np.exp(-np.clip(decode(np.arange(FEATURES))[2] @ w, -30, 30)))


def accepted(spans: list[Span], codes: list[int], probability: np.ndarray, accept: float = ACCEPT) -> list[Span]:
    """The base spans, and of the others those found likely; only secrets may overlap a base span.

    Where others overlap each other, the first one stays, of equal starts the longest. A secret
    that holds a card number by chance stays beside it.
    """
    kept = [s for s in spans if s[1] < len(BASE)]
    starts, ends = [s[0] for s in kept], []
    for span in kept:
        ends.append(max(span[2], ends[-1] if ends else 0))
    done = 0
    for p, start, end, kind in sorted(
        ((probability[c], s[0], s[2], s[1]) for s, c in zip(spans, codes) if s[1] >= len(BASE)),
        key=lambda x: (x[1], -x[2], x[3]),
    ):
        before = bisect_left(starts, end)  # base spans that begin before this one ends
        apart = KINDS[kind] == "secret" or not before or ends[before - 1] <= start
        if p >= accept and start >= done and apart:
            kept.append((start, kind, end))
            done = end
    return sorted(kept)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find(found: DataFrame, probability: np.ndarray) -> DataFrame:
    """Per document: ``doc_id, n_email, n_ip, n_card, n_phone, base, spans`` (written out)."""
    given = found.sparkSession.sparkContext.broadcast(probability)
    counts = [f"n_{kind}" for kind in BASE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(BASE) + 2)]
            for flat, codes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = list(zip(flat[::3], flat[1::3], flat[2::3]))
                base = [s for s in spans if s[1] < len(BASE)]
                for kind in range(len(BASE)):
                    columns[kind].append(sum(s[1] == kind for s in base))
                columns[-2].append(written(base))
                columns[-1].append(written(accepted(spans, codes, given.value)))
            arrays = [pa.array(c, pa.int64()) for c in columns[:-2]] + [pa.array(c, pa.string()) for c in columns[-2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *counts, "base", "spans"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base string, spans string"
    return found.mapInArrow(run, schema)


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data of every document: see ``find`` (an action per step).

    Candidates of all documents are stored, the labelers' reliabilities and the classifier are learned
    from their counts, and the stored candidates are judged. Base spans always stay. Null and
    empty texts have no spans. Repeated rows give a row each; an empty table none. Only
    ``doc_id`` and ``text`` are read.
    """
    found = candidates(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return find(found, fit(found))


def replaced(text: str | None, spans: list[Span]) -> str | None:
    """The text with its spans, sorted, each replaced by its kind; overlapping ones by that of the first."""
    if not text:
        return text
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; all columns and rows stay (an action).

    Rows and candidates are stored once; only texts and their spans cross into Python. Overlapping spans become one, named for the first. ``n_chars``, where there is such a
    column, is counted anew. Null texts stay null.
    """
    names = docs.columns
    stored = candidates(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    probability = docs.sparkSession.sparkContext.broadcast(fit(stored))

    def run(texts: pa.Array, spans: pa.Array, codes: pa.Array) -> pa.Array:
        out = []
        for text, flat, code in zip(texts, spans.to_pylist(), codes.to_pylist()):
            found = accepted(list(zip(flat[::3], flat[1::3], flat[2::3])), code, probability.value)
            out.append(replaced(text.as_py(), found))
        return pa.array(out, pa.string())

    clean = F.arrow_udf(run, "string")
    # Texts without a candidate stay in the JVM.
    text = F.col("row.text").cast("string")
    some = F.size("spans") > 0
    cleaned = stored.select("row", "spans", clean(F.when(some, text), "spans", "codes").alias("new"))
    given = {c: F.col("row").getField(c) for c in names}
    given["text"] = F.when(F.size("spans") > 0, F.col("new")).otherwise(F.col("row.text"))
    out = cleaned.select(*[v.alias(c) for c, v in given.items()])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
