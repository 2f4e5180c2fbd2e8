"""Selecting text and attributes from HTML inside Arrow batches.

``select_fields`` is the one job here: pages in, one row per page or card out. The
spec says which selector feeds which column; everything that follows (numbers,
types, addresses) is done with native column expressions.

Selectors: tag, ``.class``, ``[attr]``, ``[attr="v"]``, ``[attr*="v"]``, descendant,
comma list.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from homeledger.session import ship_package

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template"}
SLICE = 256
_PART = re.compile(r'([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:(\*?=)"([^"]*)")?\]')


@dataclass(frozen=True)
class Pick:
    """What to take from the first (or every) match of a selector.

    ``attrs`` names attributes to try in order instead of the text; an empty
    selector means the card itself. ``each`` collects one struct per match.
    """

    selector: str = ""
    attrs: tuple[str, ...] = ()
    every: bool = False
    each: tuple[tuple[str, "Pick"], ...] = ()

    def arrow_type(self) -> pa.DataType:
        if self.each:
            return pa.list_(pa.struct([(n, p.arrow_type()) for n, p in self.each]))
        return pa.list_(pa.string()) if self.every else pa.string()

    def ddl(self) -> str:
        if self.each:
            inner = ", ".join(f"{n}: {p.ddl()}" for n, p in self.each)
            return f"array<struct<{inner}>>"
        return "array<string>" if self.every else "string"


class Page(list):
    """All elements of a page in document order, also listed by class and by tag."""

    def __init__(self):
        super().__init__()
        self.by_class: dict[str, list[Node]] = {}
        self.by_tag: dict[str, list[Node]] = {}


class Node:
    """An element. ``page[at + 1:end]`` are the elements below it, in document order."""

    __slots__ = ("tag", "attrs", "classes", "parent", "children", "page", "at", "end")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None", page: Page, classes: frozenset | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.classes = frozenset(attrs.get("class", "").split()) if classes is None else classes
        self.page, self.at, self.end = page, len(page), len(page) + 1
        page.append(self)
        page.by_tag.setdefault(tag, []).append(self)
        for name in self.classes:
            page.by_class.setdefault(name, []).append(self)
        if parent is not None:
            parent.children.append(self)

    def text(self) -> str:
        """Text nodes stripped one by one and joined without a separator, at any depth."""
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0].strip()
        out, waiting = [], [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, str):
                out.append(child.strip())
            elif child.tag not in HIDDEN:
                waiting.append(iter(child.children))
        return "".join(out)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open = Node("", {}, None, self.page)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open, self.page)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        Node(tag, {k: v or "" for k, v in attrs}, self.open, self.page)

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


_RAW = {"script", "style"}
# Elements whose content some versions of the parser read otherwise.
_SPECIAL = {"textarea", "iframe", "noembed", "noframes", "noscript", "plaintext", "xmp"}
_TAG = re.compile(r'(/?)([a-zA-Z][a-zA-Z0-9]*)((?: [a-zA-Z][a-zA-Z0-9-]*="[^"&]*")*)')
_ATTRIBUTE = re.compile(r' ([a-zA-Z][a-zA-Z0-9-]*)="([^"]*)"')


def _read_tag(source: str):
    """``(whether it closes, tag, attributes, classes)`` of plain markup between angle brackets, else None."""
    found = _TAG.fullmatch(source)
    if found is None or (found[1] and found[3]):
        return None
    tag = found[2].lower()
    attrs = {k.lower(): v for k, v in _ATTRIBUTE.findall(found[3])}
    return None if tag in _SPECIAL else (bool(found[1]), tag, attrs, frozenset(attrs.get("class", "").split()))


_tag = lru_cache(maxsize=4096)(_read_tag)


def _plain(html: str) -> Page | None:
    """The elements of a page of plain tags and text, as the parser finds them; None for any other markup."""
    page = Page()
    root = here = Node("", {}, None, page)
    pieces = html.split("<")
    if pieces[0]:
        root.children.append(unescape(pieces[0]))
    raw = None
    for piece in pieces[1:]:
        source, ended, text = piece.partition(">")
        known = _tag(source) if ended else None
        if known is None:
            return None
        closes, tag, attrs, classes = known
        if raw is not None and not (closes and tag == raw):
            return None
        raw = None
        if not closes:
            node = Node(tag, attrs, here, page, classes)
            if tag in _RAW:
                raw = tag
            if tag not in VOID:
                here = node
        else:
            node = here
            while node.parent is not None and node.tag != tag:
                node = node.parent
            if node.parent is not None:
                here = node.parent
        if text:
            here.children.append(text if raw or "&" not in text else unescape(text))
    return page if raw is None else None


def _parsed(html: str) -> Page:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.page


def parse(html: str) -> Node:
    page = _plain(html)
    return _linked(_parsed(html) if page is None else page)


def _linked(page: Page) -> Node:
    for node in reversed(page):
        parent = node.parent
        if parent is not None and parent.end < node.end:
            parent.end = node.end
    return page[0]


@lru_cache(maxsize=512)
def _compile(selector: str):
    """Per alternative its steps, the class or tag to look up, and whether having it is all that is asked."""
    chains = []
    for group in selector.split(","):
        chain = [_PART.findall(step) for step in group.split()]
        tag = next((t for t, *_ in chain[-1] if t), None)
        cls = next((c for _, c, *_ in chain[-1] if c), None)
        chains.append((chain, tag, cls, len(chain) == 1 and len(chain[0]) == 1 and bool(cls or tag)))
    return chains


def _fits_attr(attrs: dict, attr: str, op: str, want: str) -> bool:
    have = attrs.get(attr)
    return not (have is None or (op == "=" and have != want) or (op == "*=" and want not in have))


def _fits(node: "Node | _Path", parts) -> bool:
    for tag, cls, attr, op, want in parts:
        if tag and node.tag != tag:
            return False
        if cls and cls not in node.classes:
            return False
        if attr and not _fits_attr(node.attrs, attr, op, want):
            return False
    return True


def _matches(node: "Node | _Path", chain) -> bool:
    if not _fits(node, chain[-1]):
        return False
    up = node.parent
    for parts in reversed(chain[:-1]):
        while up is not None and not _fits(up, parts):
            up = up.parent
        if up is None:
            return False
        up = up.parent
    return True


def select(root: Node, selector: str) -> Iterator[Node]:
    """Elements below ``root`` that fit, in document order; only those with the last step's class or tag are tried."""
    found = [_chain(root, *compiled) for compiled in _compile(selector)]
    if len(found) == 1:
        return found[0]
    found = [list(part) for part in found]
    if sum(map(bool, found)) < 2:
        return iter(next(filter(None, found), ()))
    return iter(sorted({n.at: n for part in found for n in part}.values(), key=lambda n: n.at))


def _chain(root: Node, chain, tag: str | None, cls: str | None, enough: bool) -> Iterator[Node]:
    page = root.page
    pool = page.by_class.get(cls, ()) if cls else page.by_tag.get(tag, ()) if tag else page
    # The root of a page stands before all others; only below a card is the place looked for.
    first = bisect_right(pool, root.at, key=lambda n: n.at) if root.at else int(pool is page)
    for i in range(first, len(pool)):
        if pool[i].at >= root.end:
            return
        if enough or _matches(pool[i], chain):
            yield pool[i]


def _value(node: Node, attrs: tuple[str, ...]):
    if not attrs:
        return node.text()
    return next((node.attrs[a] for a in attrs if node.attrs.get(a)), None)


def pick(root: Node, p: Pick):
    if p.each:
        return [{n: pick(m, q) for n, q in p.each} for m in select(root, p.selector)]
    if p.every:
        return [v for m in select(root, p.selector) if (v := _value(m, p.attrs)) is not None]
    node = next(select(root, p.selector), None) if p.selector else root
    return None if node is None else _value(node, p.attrs)


def _cards(root: Node, scopes: tuple[str, ...]) -> list[Node]:
    for s in scopes:
        found = list(select(root, s))
        if found:
            return found
    return []


class _Path:
    """The open elements from a page's root down to one, as far as the selectors tell elements apart."""

    __slots__ = ("tag", "attrs", "classes", "parent", "depth", "hidden", "raw", "void", "steps", "hits", "card")

    def __init__(self, tag: str, attrs: dict, classes: frozenset, parent: "_Path | None"):
        self.tag, self.attrs, self.classes, self.parent = tag, attrs, classes, parent
        self.depth = parent.depth + 1 if parent else 0
        # The depth of the lowest hidden element; the text there belongs to no element above it.
        self.hidden = self.depth if tag in HIDDEN else parent.hidden if parent else 0
        self.raw, self.void = tag in _RAW, tag in VOID
        self.steps: dict[int, tuple[_Path, _Path | None]] = {}
        self.hits, self.card = None, False


class _Plain:
    """Tags and texts of a plain page; ``plain`` are the texts with character references resolved."""

    def __init__(self, reader: "_Reader", html: str):
        parts = html.replace(">", "<").split("<")
        texts = parts[::2]
        self.reader, self.tags, self.texts = reader, parts[1::2], texts
        self.plain = [unescape(t) if "&" in t else t for t in texts] if "&" in html else texts
        self.seen: dict[int, dict] = {}

    def attrs(self, at: int) -> dict:
        found = self.seen.get(at)
        return self.reader._form(self.tags[at])[1] if found is None else found


_FIRST, _EVERY, _EACH = range(3)
_UNSET = object()
_OTHER = bytes(set(range(256)) - set(b"<>"))
MOST_KNOWN = 20_000  # paths, kinds of tags, tags
MOST_PLANNED = 2_000_000  # tags of all plans
DEEPEST = 256


class _Reader:
    """Picks from plain pages by plans kept from pages or cards of the same tags, without building elements.

    What a tag does (which elements it closes, which selectors its element fits) depends only on the path it stands
    on, and where a page's or card's fields stand only on its tags: both are worked out once and kept.
    """

    def __init__(self, spec: tuple[tuple[str, Pick], ...], scope: str | None):
        self.scope = [c[0] for c in _compile(scope)] if scope else []
        self.levels: list[list] = []
        self._level(spec)
        chains = [c for level in self.levels for *_, chains in level for c in chains] + self.scope
        parts = [part for chain in chains for step in chain for part in step]
        self.classes = frozenset(c for _, c, *_ in parts if c)
        self.tests = sorted({(a, op, want) for _, _, a, op, want in parts if a})
        self._forget()

    def _level(self, spec) -> int:
        at = len(self.levels)
        self.levels.append([])
        for name, p in spec:
            below = self._level(p.each) if p.each else 0
            kind = _EACH if p.each else _EVERY if p.every else _FIRST
            chains = [c[0] for c in _compile(p.selector)] if p.selector or kind else []
            self.levels[at].append((name, kind, p.attrs, below, chains))
        return at

    def _forget(self):
        self.root = _Path("", {}, frozenset(), None)
        self.paths = self.planned = 0
        self.known, self.forms, self.shapes, self.kinds, self.starts, self.plans = {}, {}, {}, [], set(), {}

    def _form(self, source: str):
        """``(form, attributes)`` of a tag; tags of one form differ in attributes' values only. None: not plain."""
        parts = source.split('"')
        key = tuple(parts[::2])
        form = self.forms.get(key)
        if form is None:
            if (tag := _read_tag(source)) is None:
                return None
            if len(self.forms) >= MOST_KNOWN:
                self.forms.clear()
            names = tuple(n.lower() for n, _ in _ATTRIBUTE.findall(source))
            tests = [test for test in self.tests if test[0] in names]
            form = self.forms[key] = tag[0], tag[1], names, tests, {}
        elif "&" in source:
            return None
        return form, dict(zip(form[2], parts[1::2]))

    def _learn(self, source: str):
        """``(shape, attributes)`` of a tag; tags of one shape are alike to all selectors. None: not plain."""
        if (found := self._form(source)) is None:
            return None
        (closes, name, names, tests, own), attrs = found
        value = attrs.get("class")
        key = value, *[_fits_attr(attrs, *test) for test in tests]
        shape = own.get(key)
        if shape is None:
            classes = frozenset((value or "").split())
            every = closes, name, classes & self.classes, tuple(_fits_attr(attrs, *test) for test in self.tests)
            shape = self.shapes.get(every)
            if shape is None:
                shape = self.shapes[every] = len(self.kinds)
                self.kinds.append((closes, name, attrs, classes))
                if not closes and any(_fits(_Path(name, attrs, classes, None), c[-1]) for c in self.scope):
                    self.starts.add(shape)
            if len(own) >= MOST_KNOWN:
                own.clear()
            own[key] = shape
        if names in ((), ("class",)):
            if len(self.known) >= MOST_KNOWN:
                self.known.clear()
            self.known[source] = shape
        return shape, attrs

    def _step(self, path: _Path, shape: int):
        """The path after a tag and the path of the element it opens, if any; None where the parser must decide."""
        closes, tag, attrs, classes = self.kinds[shape]
        if path.raw and not (closes and tag == path.tag):
            return None
        if closes:
            node = path
            while node.parent is not None and node.tag != tag:
                node = node.parent
            step = (path if node.parent is None else node.parent), None
        else:
            if path.depth >= DEEPEST:
                return None
            node = _Path(tag, attrs, classes, path)
            hits = [
                tuple(i for i, (*_, chains) in enumerate(level) if any(_matches(node, c) for c in chains))
                for level in self.levels
            ]
            node.hits = hits if any(hits) else None
            node.card = any(_matches(node, c) for c in self.scope)
            step = (path if node.void else node), node
            self.paths += 1
        path.steps[shape] = step
        return step

    def _open(self, level: int, depth: int, at: int, captures: list | None):
        """A card, unit or page whose fields are looked for below an element; ``captures`` is None for a void one."""
        values = []
        for _, kind, names, _, chains in self.levels[level]:
            if kind != _FIRST:
                values.append([])
            elif chains:
                values.append(_UNSET)
            else:
                values.append(self._value(names, at, depth, captures))
        return depth, level, values

    @staticmethod
    def _value(names: tuple[str, ...], at: int, depth: int, captures: list | None):
        """The attributes to look at and their tag, or the list of the places of the element's texts."""
        if names:
            return at, names
        places: list[int] = []
        if captures is not None:
            captures.append((depth, places))
        return places

    def _plan(self, path: _Path, shapes: tuple[int, ...]):
        """The path after these tags, where the rows' values stand, and whether a card goes on; None: not plain.

        Places count tags from 0 and texts from the one before the first tag; that of a text taken as it stands is
        inverted.
        """
        captures, frames, rows = [], [], []
        if not self.scope:
            rows.append(self._open(0, 0, -1, captures))
            frames.append(rows[0])
            for _, places in captures:
                places.append(0)
        for at, shape in enumerate(shapes):
            step = path.steps.get(shape) or self._step(path, shape)
            if step is None:
                return None
            path, node = step
            if node is None:
                depth = path.depth
                while captures and captures[-1][0] > depth:
                    captures.pop()
                while frames and frames[-1][0] > depth:
                    frames.pop()
            elif frames or node.card:
                into, opened = None if node.void else captures, []
                if node.hits:
                    for _, level, values in frames:
                        for i in node.hits[level]:
                            _, kind, names, below, _ = self.levels[level][i]
                            if kind == _FIRST:
                                if values[i] is _UNSET:
                                    values[i] = self._value(names, at, node.depth, into)
                            elif kind == _EACH:
                                opened.append(self._open(below, node.depth, at, into))
                                values[i].append(opened[-1])
                            else:
                                values[i].append(self._value(names, at, node.depth, into))
                if node.card:
                    opened.append(self._open(0, node.depth, at, into))
                    rows.append(opened[-1])
                if opened and not node.void:
                    frames += opened
            for depth, places in captures:
                if path.hidden <= depth:
                    places.append(~(at + 1) if path.raw else at + 1)
        return path, [self._places(frame) for frame in rows], bool(frames)

    def _places(self, frame) -> tuple:
        """All columns, those of one text with a getter of these, and the others as ``(name, kind, places)``."""
        _, level, values = frame
        blank, single, others = {}, {}, []
        for (name, kind, *_), value in zip(self.levels[level], values):
            blank[name] = None
            if kind == _FIRST and type(value) is list and len(value) == 1 and value[0] >= 0:
                single[name] = value[0]
            elif value is not _UNSET:
                others.append((name, kind, [self._places(f) for f in value] if kind == _EACH else value))
        # A getter of one place gives no tuple.
        return blank, tuple(single), itemgetter(*single.values(), 0, 0), others

    @staticmethod
    def _take(places, first: int, page: "_Plain"):
        if type(places) is list:
            return "".join([page.plain[first + p].strip() if p >= 0 else page.texts[first + ~p].strip() for p in places])
        at, names = places
        attrs = page.attrs(first + at) if at >= 0 else {}
        return next((attrs[a] for a in names if attrs.get(a)), None)

    def _row(self, plan: tuple, first: int, page: "_Plain", texts: list[str]) -> dict:
        blank, single, getter, others = plan
        out = blank.copy()
        out.update(zip(single, map(str.strip, getter(texts))))
        for name, kind, places in others:
            if kind == _FIRST:
                out[name] = self._take(places, first, page)
            elif kind == _EVERY:
                found = [self._take(p, first, page) for p in places]
                out[name] = [v for v in found if v is not None]
            else:
                out[name] = [self._row(p, first, page, texts) for p in places]
        return out

    def read(self, html: str) -> list[dict] | None:
        """The rows of a page of plain tags and text, equal to those of its tree; None for any other markup."""
        marks = html.encode("utf-8", "surrogatepass").translate(None, _OTHER)
        if marks != b"<>" * (len(marks) // 2):
            return None
        if max(self.paths, len(self.kinds), self.planned * MOST_KNOWN // MOST_PLANNED) > MOST_KNOWN:
            self._forget()
        page = _Plain(self, html)
        shapes = list(map(self.known.get, page.tags))
        if None in shapes:
            for i, shape in enumerate(shapes):
                if shape is None:
                    if (tag := self._learn(page.tags[i])) is None:
                        return None
                    shapes[i], page.seen[i] = tag
        # One plan from each tag that may open a card to the next.
        starts = self.starts
        cuts = [0, *[i for i, shape in enumerate(shapes) if shape in starts and i], len(shapes)] if starts else [0, len(shapes)]
        rows, path = [], self.root
        for first, end in zip(cuts, cuts[1:]):
            key = path, *shapes[first:end]
            plan = self.plans.get(key)
            if plan is None:
                plan = self._plan(path, key[1:])
                if plan is None:
                    return None
                self.plans[key] = plan
                self.planned += len(key)
            if plan[2] and end < len(shapes):
                # This card goes on beyond the next tag that may open one.
                if (plan := self._plan(path, shapes[first:])) is None:
                    return None
                end = len(shapes)
            path, found, _ = plan
            if found:
                texts = page.plain[first : end + 1]
                rows += [self._row(row, first, page, texts) for row in found]
            if end == len(shapes):
                break
        return None if path.raw else rows


@lru_cache(maxsize=64)
def _readers(spec: tuple[tuple[str, Pick], ...], cards: tuple[str, ...]) -> list[_Reader]:
    return [_Reader(spec, scope) for scope in cards or (None,)]


def _read(html: str, readers: list[_Reader]) -> list[dict] | None:
    """The rows of the first reader that finds any; None if the page is not plain."""
    for reader in readers:
        rows = reader.read(html)
        if rows is None or rows:
            return rows
    return []


def _rows(
    html: str | None, spec: dict[str, Pick], cards: tuple[str, ...], readers: list[_Reader]
) -> tuple[list[dict], str | None]:
    """What a page gives, and why it gives nothing: the parser raises on some broken markup.

    ``readers`` is empty at the first page and keeps what later ones share.
    """
    try:
        if not readers:
            readers += _readers(tuple(spec.items()), cards)
        if (plain := _read(html or "", readers)) is not None:
            return plain, None
        root = _linked(_parsed(html or ""))
        found = _cards(root, cards) if cards else [root]
        return [{n: pick(card, p) for n, p in spec.items()} for card in found], None
    except (AssertionError, ValueError, IndexError, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}"


def select_fields(
    pages: DataFrame, spec: dict[str, Pick], cards: tuple[str, ...] = (), html: str = "html", errors: str | None = None
) -> DataFrame:
    """One row per page, or per card with its position, holding the picked fields.

    ``cards`` are tried in order; the first selector with any match gives the cards. A page that
    cannot be parsed fails alone: without cards it is a row of nulls, with cards it has none. With ``errors``, the name
    of a further column, it is a row in either case and the column says why (null on good rows).
    """
    keep = [c for c in pages.columns if c != html]
    extra = [("pos", "int", pa.int32())] if cards else []
    ddl = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in keep]
        + [f"{n} {d}" for n, d, _ in extra]
        + [f"`{n}` {p.ddl()}" for n, p in spec.items()]
        + ([f"`{errors}` string"] if errors else [])
    )
    new_fields = [pa.field(n, t) for n, _, t in extra]
    new_fields += [pa.field(n, p.arrow_type()) for n, p in spec.items()]
    new_fields += [pa.field(errors, pa.string())] if errors else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parsed pages are large, so an Arrow batch is worked off in slices.
        slices = (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE))
        readers: list[_Reader] = []
        for batch in slices:
            source = batch.column(batch.schema.get_field_index(html))
            at, rows = [], []
            for i, text in enumerate(source.to_pylist()):
                found, error = _rows(text, spec, cards, readers)
                if error is not None and (errors or not cards):
                    found = [{}]
                for pos, row in enumerate(found):
                    if cards and error is None:
                        row["pos"] = pos
                    if errors:
                        row[errors] = error
                    at.append(i)
                    rows.append(row)
            kept = pa.table(batch.select(keep).columns, names=keep) if keep else None
            taken = kept.take(pa.array(at, pa.int64())) if keep else None
            columns = list(taken.columns) if keep else []
            columns += [pa.array([r.get(f.name) for r in rows], f.type) for f in new_fields]
            out = pa.table(columns, names=keep + [f.name for f in new_fields])
            yield from out.combine_chunks().to_batches()

    ship_package(pages.sparkSession)
    return pages.select(*keep, html).mapInArrow(run, ddl)
