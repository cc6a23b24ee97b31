"""Tables of filings: their grid, and wide ones in parts that a narrow page holds.  No text of a cell is lost."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from heapq import heappop, heappush

from sedimenta.functions.markup import SPLIT, TAG, _classes, alignment, attributes, is_amount, plain_text, traits  # noqa: F401

#: Em of a page and columns of a part, columns of a label, live columns that a heading binds, and nested levels.
BUDGET, COLUMNS, LABELS, BOUND, DEPTH = 15.0, 6, 3, 4, 3
#: Most columns and rows of a span, as the HTML standard has them.
SPANS = 1000, 65534
#: Tags and their characters up to which a layout is kept for tables with the same tags, and of how many tables.
KEPT_TAGS, KEPT_CHARS, KEPT_TABLES = 1000, 20_000, 512

_TABLE = re.compile(r"<table(?=[\s>/])", re.I)


@dataclass(eq=False, slots=True)
class Cell:
    row: int
    col: int
    cs: int
    rs: int
    tag: str
    own: dict[str, str | None]
    inner: str
    text: str
    look: str = ""  # the attributes that stay, as they are written


@dataclass
class Grid:
    """Cells laid out with their spans, found by row and by column.

    live: the columns where some text begins; widest: the least width of what begins in a column.
    """

    cells: list[Cell]
    rows: int
    columns: int
    row_class: dict[int, str]

    @cached_property
    def by_column(self) -> dict[int, list[Cell]]:
        out: dict[int, list[Cell]] = {}
        for c in self.cells:
            out.setdefault(c.col, []).append(c)
        return out

    @cached_property
    def live(self) -> list[int]:
        return sorted({c.col for c in self.cells if c.text})

    @cached_property
    def traits(self) -> dict[str, tuple[float, bool, bool, bool]]:
        return {t: traits(t) for t in {c.text for c in self.cells}}

    @cached_property
    def widest(self) -> dict[int, float]:
        known = self.traits
        return {col: max([known[c.text][0] for c in cells]) for col, cells in self.by_column.items()}

    @cached_property
    def labels(self) -> list[int]:
        return labels(self)

    def starting(self, column: int) -> list[Cell]:
        return self.by_column.get(column, [])

    def under(self, c: Cell) -> tuple[int, int]:
        """The places in live of the columns that a cell covers: from, to (exclusive)."""
        return bisect_left(self.live, c.col), bisect_left(self.live, c.col + c.cs)


class _Taken:
    """The columns that cells of rows above hold in a row: intervals without a gap between them, and when each span ends."""

    def __init__(self):
        self.ends: list[tuple[int, int, int]] = []  # last row, first and last column
        self.intervals: list[tuple[int, int]] = []

    def row(self, row: int) -> None:
        """Spans that end before a row leave."""
        if self.ends and self.ends[0][0] < row:
            while self.ends and self.ends[0][0] < row:
                heappop(self.ends)
            self.intervals = []
            for _, a, b in sorted(self.ends, key=lambda x: x[1]):
                if self.intervals and a <= self.intervals[-1][1] + 1:
                    self.intervals[-1] = self.intervals[-1][0], max(b, self.intervals[-1][1])
                else:
                    self.intervals.append((a, b))

    def add(self, spans: list[tuple[int, int, int]]) -> None:
        """Spans of the row at hand, which hold from the next one on."""
        for x in spans:
            heappush(self.ends, x)
        both = sorted([*self.intervals, *((a, b) for _, a, b in spans)])
        self.intervals = both[:1]
        for a, b in both[1:]:
            if a <= self.intervals[-1][1] + 1:
                self.intervals[-1] = self.intervals[-1][0], max(b, self.intervals[-1][1])
            else:
                self.intervals.append((a, b))


def parts_of(html: str) -> tuple[list[str], tuple[str, ...]]:
    """Markup as texts and tags by turns, and its tags; tag k is piece 2 * k + 1."""
    pieces = SPLIT.split(html)
    return pieces, tuple(pieces[1::2])


@lru_cache(4096)
def _short_tag(tag: str) -> tuple[str, str, str]:
    return _long_tag(tag)


def _long_tag(tag: str) -> tuple[str, str, str]:
    end, name, own = TAG.fullmatch(tag).groups()
    return end, name.lower(), own


def _tag(tag: str) -> tuple[str, str, str]:
    """The slash of a tag, its name in small letters, and its attributes."""
    return _short_tag(tag) if len(tag) < 300 else _long_tag(tag)


def table_end(tags: tuple[str, ...], start: int) -> int | None:
    """The tag that closes the table whose tag is at start."""
    depth = 1
    for k in range(start + 1, len(tags)):
        end, name, own = _tag(tags[k])
        if name == "table" and not own.endswith("/"):
            depth += -1 if end else 1
            if not depth:
                return k
    return None


def _outermost(tags: tuple[str, ...]) -> list[tuple[int, int | None]]:
    """The tags that open and close the tables that lie in no other; nothing closes one that is not closed."""
    out, k = [], 0
    while k < len(tags):
        end, name, own = _tag(tags[k]) if tags[k][:6].lower() == "<table" else ("", "", "")
        if name == "table" and not own.endswith("/"):
            end = table_end(tags, k)
            out.append((k, end))
            k = k if end is None else end
        k += 1
    return out


_kept_outermost = lru_cache(KEPT_TABLES)(_outermost)


def outermost(tags: tuple[str, ...]) -> list[tuple[int, int | None]]:
    return (_kept_outermost if _short(tags) else _outermost)(tags)


def _short(tags: tuple[str, ...]) -> bool:
    return len(tags) <= KEPT_TAGS and sum(map(len, tags)) <= KEPT_CHARS


def _span(value: str | None, most: int) -> int:
    return min(max(1, int(value)), most) if value and value.isascii() and value.isdigit() and len(value) < 10 else 1


def _cells(tags: tuple[str, ...], at: int) -> Iterator[tuple[str, str, int, int]]:
    """(tr, its attributes, 0, 0) and (td or th, its attributes, and from which piece to which it holds) of a table from a tag on, in one pass.

    A cell that is not closed ends where the next cell or row begins.
    """
    depth, cell, k = 0, None, at  # tables inside; name, attributes and first piece of the open cell
    for k in range(at, len(tags)):
        end, name, own = _tag(tags[k])
        if name == "table":
            depth += -1 if end else 1
            if depth < 0:
                break
        elif not depth and name in ("td", "th", "tr"):
            if cell and (not end or name in (cell[0], "tr")):
                yield *cell, 2 * k + 1
                cell = None
            if end:
                continue
            if name == "tr" or own.endswith("/"):
                yield name, own, 0, 0
            else:
                cell = name, own, 2 * k + 2
    if cell:
        yield *cell, 2 * k + 1


def _look(own: dict[str, str | None]) -> str:
    kept = {"id": own.get("id"), "class": _classes(own.get("class")), "style": f"text-align:{to}" if (to := alignment(own)) else None}
    return "".join(f' {k}="{v}"' for k, v in kept.items() if v)


def _layout(tags: tuple[str, ...], at: int) -> tuple[list[tuple], int, int, dict[int, str]]:
    """Where the cells of a table lie: (row, col, cs, rs, tag, own, look, first and last piece) each, rows, columns, classes of rows."""
    cells: list[tuple] = []
    row_class: dict[int, str] = {}
    taken, rows, columns = _Taken(), 0, 0
    next_, k, down = 1, 0, []  # the next column of the row, the place in the intervals taken, spans to rows below
    for name, raw, begin, end in _cells(tags, at):
        own = attributes(raw) if raw else {}
        if name == "tr":
            if down:
                taken.add(down)
            rows, next_, k, down = rows + 1, 1, 0, []
            taken.row(rows)
            row_class[rows] = _classes(own.get("class"))
            continue
        rows = max(1, rows)
        while k < len(taken.intervals) and taken.intervals[k][0] <= next_:
            next_, k = max(next_, taken.intervals[k][1] + 1), k + 1
        cs, rs = _span(own.get("colspan"), SPANS[0]), _span(own.get("rowspan"), SPANS[1])
        cells.append((rows, next_, cs, rs, name, own, _look(own) if own else "", begin, end))
        if rs > 1:
            down.append((rows + rs - 1, next_, next_ + cs - 1))
        next_ += cs
        columns = max(columns, next_ - 1)
    return cells, rows, columns, row_class


_kept_layout = lru_cache(KEPT_TABLES)(_layout)


def grid(table: str) -> Grid:
    """The grid of a table (its tags included); nested tables belong to the cell that holds them."""
    pieces, tags = parts_of(table)
    return laid_out(pieces, tags, int(bool(tags) and not pieces[0]))


def laid_out(pieces: list[str], tags: tuple[str, ...], at: int = 1) -> Grid:
    """The grid of a table that is dealt into texts and tags, from a tag on; tables with the same tags share their layout."""
    found, rows, columns, row_class = (_kept_layout if _short(tags) else _layout)(tags, at)
    cells = []
    for row, col, cs, rs, tag, own, look, a, b in found:
        inner = pieces[a] if b - a == 1 else "".join(pieces[a:b])
        cells.append(Cell(row, col, cs, rs, tag, own, inner, plain_text(inner) if inner else "", look))
    return Grid(cells, rows, columns, row_class)


def labels(g: Grid) -> list[int]:
    """The columns that name the rows: leading ones with more text than numbers, LABELS at most, one at least."""
    out = []
    for col in g.live[:LABELS]:
        texts = [g.traits[c.text] for c in g.starting(col) if c.text]
        if 2 * sum([x[1] for x in texts]) >= len(texts) or 2 * sum([x[3] for x in texts]) < len(texts):
            break
        out.append(col)
    return out or g.live[:1]


def bound(g: Grid) -> set[int]:
    """Live columns that must stay with the next one, as one cell spans both and not many more."""
    out: set[int] = set()
    for c in g.cells:
        if c.cs > 1:
            a, b = g.under(c)
            if 1 < b - a <= BOUND:
                out.update(g.live[a : b - 1])
    return out


def width(g: Grid, columns: list[int]) -> float:
    """The least width of columns: their widest unbreakable texts and an em for each."""
    return sum([g.widest.get(col, 0.0) + 1.0 for col in columns])


def headed(g: Grid) -> set[int]:
    """Live columns whose headings are those of the live column before.

    Headings are the texts above the first row with two amounts.  Two columns have the same ones if
    some text stands above them and none above only one of them.
    """
    amounts: dict[int, int] = {}
    first = 1
    for c in g.cells:  # row by row
        if g.traits[c.text][2]:
            amounts[c.row] = amounts.get(c.row, 0) + 1
            if amounts[c.row] == 2:
                first = c.row
                break
    cut, change = set(), [0] * (len(g.live) + 1)
    for c in g.cells:
        if c.row >= first:
            break
        if c.text:
            a, b = g.under(c)
            cut.update((a, b))
            change[a] += 1
            change[b] -= 1
    above, out = 0, set()
    for k, col in enumerate(g.live):
        above += change[k]
        if above and k not in cut:
            out.add(col)
    return out


def chunks(g: Grid, budget: float = BUDGET, most: int | None = COLUMNS) -> list[list[int]]:
    """The live columns in parts, each with the labels: columns under one heading stay together while they fit.

    A group that does not fit begins a new part, and is cut between columns that are not bound.  The
    first piece of a part is taken even if it alone is too wide.
    """
    label = g.labels
    own, same, tied = width(g, label), headed(g), bound(g)
    groups: list[list[int]] = []
    for col in g.live[len(label) :]:
        if groups and col in same:
            groups[-1].append(col)
        else:
            groups.append([col])
    fits = lambda em, n: own + em <= budget and (most is None or len(label) + n <= most)
    pieces: list[tuple[list[int], bool]] = []  # columns, and whether a new part must begin before them
    for group in groups:
        if fits(width(g, group), len(group)):
            pieces.append((group, False))
            continue
        cut = [[group[0]]]
        for before, col in zip(group, group[1:], strict=False):
            if before in tied:
                cut[-1].append(col)
            else:
                cut.append([col])
        pieces += [(p, k == 0) for k, p in enumerate(cut)]
    out: list[list[int]] = []
    used = 0.0
    for cols, new in pieces:
        em = width(g, cols)
        if not out or new or not fits(used + em, len(out[-1]) + len(cols)):
            out.append([])
            used = 0.0
        out[-1] += cols
        used += em
    return [sorted(label + cols) for cols in out] or ([g.live] if g.live else [])


def render(g: Grid, columns: list[int]) -> str:
    """The table with some of its columns, in order: spans are counted anew, rows without text go."""
    rows: dict[int, list[Cell]] = {}
    for col in columns:
        for c in g.starting(col):
            rows.setdefault(c.row, []).append(c)
    kept = sorted(r for r, cells in rows.items() if any(c.text for c in cells))
    out = ["<table>"]
    for r in kept:
        out.append(f'<tr class="{g.row_class[r]}">' if g.row_class.get(r) else "<tr>")
        for c in rows[r]:
            across = bisect_left(columns, c.col + c.cs) - bisect_left(columns, c.col) if c.cs > 1 else 1
            down = bisect_left(kept, c.row + c.rs) - bisect_left(kept, c.row) if c.rs > 1 else 1
            spans = (f' colspan="{across}"' if across > 1 else "") + (f' rowspan="{down}"' if down > 1 else "")
            out.append(f"<{c.tag}{spans}{c.look}>{c.inner}</{c.tag}>")
        out.append("</tr>")
    return "".join([*out, "</table>"])


def _tables(html: str) -> int:
    return len(_TABLE.findall(html))


def split_wide(html: str, budget: float = BUDGET, most: int = COLUMNS, depth: int = 0) -> tuple[str, dict[str, int]]:
    """Markup whose tables that are too wide are cut into parts, and those with empty columns lose them.

    Counts tables, split, subtables, kept and collapsed.  A table is left alone if it is not closed,
    or if one inside it lies outside its cells.
    """
    found = dict.fromkeys(("tables", "split", "subtables", "kept", "collapsed"), 0)

    def inside(part: str) -> str:
        if depth >= DEPTH or not _tables(part):
            return part
        text, more = split_wide(part, budget, most, depth + 1)
        for k, n in more.items():
            found[k] += n
        return text

    pieces, tags = parts_of(html)
    out, at = [], 0  # pieces up to at are in out
    for k, last in outermost(tags):
        if last is None:
            break
        out += pieces[at : 2 * k + 1]
        at = 2 * last + 2
        some = ["", *pieces[2 * k + 1 : at], ""]
        part = "".join(some)
        found["tables"] += 1
        g = laid_out(some, tags[k : last + 1])
        n = _tables(part)
        alone = n == 1 and _TABLE.match(part) is not None
        whole = alone or n == 1 + sum(_tables(c.inner) for c in g.cells)
        parts = chunks(g, budget, None if width(g, g.live) <= budget else most) if whole else []
        if len(parts) > 1 or parts and g.columns > len(g.live):
            for c in () if alone else g.cells:
                if _tables(c.inner):
                    c.inner = inside(c.inner)
                    c.text = plain_text(c.inner)
            out += [render(g, p) for p in parts]
            found["split" if len(parts) > 1 else "collapsed"] += 1
            found["subtables"] += len(parts) if len(parts) > 1 else 0
        else:
            head = len(tags[k])
            out.append(part[:head] + inside(part[head:-len("</table>")]) + part[-len("</table>") :] if n > 1 else part)
            found["kept"] += 1
    return "".join([*out, *pieces[at:]]), found
