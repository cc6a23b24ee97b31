"""Markup of any kind as well-formed XML, in one pass over its tags with a stack of the elements that are open.

A start tag closes what cannot hold it (a paragraph before a block, a row before a row, a cell before
a cell), an end tag closes what is open inside its element, one without an element goes, and what is
open at the end is closed.  No text is lost: a bracket that begins no tag is text.  What is open is
known by name and by place, so a tag costs the same at any depth, and time follows the length of the
markup.  What a tag becomes depends on the tags before it and not on texts, so documents that have the
same tags share one walk.

On the way tags are reduced to what stays (see markup): elements that only change the look and inline
data lose their tags, scripts, styles, titles and the submission's envelope go whole, void elements are
closed, attributes are reduced, and entities become characters.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

from sedimenta.functions.markup import ALIGNED, DROPPED, KEPT, UNWRAPPED, VOID, _classes, alignment, attributes, without

#: Fixed values of the HTML standard: blocks before which a paragraph ends, and for each start tag the elements
#: that it ends, up to the nearest one that bounds it.
BLOCKS = "address article aside blockquote details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
IMPLIED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    **{b: (("p",), ("table", "td", "th", "caption", "button")) for b in BLOCKS},
    "li": (("li",), ("ul", "ol", "menu", "dir", "table", "td", "th", "caption")),
    **{d: (("dt", "dd"), ("dl", "table", "td", "th", "caption")) for d in ("dt", "dd")},
    "option": (("option",), ("select", "table", "td", "th", "caption")),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    **{c: (("td", "th", "caption", "colgroup"), ("table",)) for c in ("td", "th")},
    **{g: (("thead", "tbody", "tfoot", "tr", "caption", "colgroup"), ("table",)) for g in ("thead", "tbody", "tfoot")},
}
#: What an end tag does not reach across; the parts of a table are bounded by their table only, and a table by nothing.
BOUNDS = ("table", "td", "th", "caption")
PARTS = ("tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot")

#: A tag (a bracket inside must be quoted), a comment, marked text, or another declaration.
TOKEN = re.compile(r"""<(?:(/?)([A-Za-z][\w:.-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|!--(.*?)-->|!\[CDATA\[(.*?)\]\]>|[!?][^>]*+>)""", re.S | re.ASCII)
_SPLIT = re.compile(r"""(<(?:/?[A-Za-z][\w:.-]*+(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>|!--.*?-->|!\[CDATA\[.*?\]\]>|[!?][^>]*+>))""", re.S | re.ASCII)
_LEGAL = "\t\n\r\x20-\ud7ff\ue000-\ufefe\uff00-\ufffd\U00010000-\U0010ffff"
_ILLEGAL = re.compile(f"[^{_LEGAL}]")
_HUGE = re.compile("&#(?:[0-9]{10,}|[xX][0-9A-Fa-f]{10,});?")
_ODD = re.compile(f"[&<>]|[^{_LEGAL}]")
#: Characters of a tag up to which it is kept once parsed, and tags of a document and their characters up to which its walk is kept.
SHORT, KEPT_TAGS, KEPT_CHARS = 300, 1000, 20_000


def text(raw: str) -> str:
    """Text as XML has it: entities as characters, what XML forbids left out, brackets and ampersands escaped."""
    if not _ODD.search(raw):
        return raw
    raw = _ILLEGAL.sub("", _html.unescape(_HUGE.sub("", raw)))
    return raw.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


_OPEN = re.compile("(&(?!(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);))")


def loose_text(raw: str) -> str:
    """Text as text() has it, but an ampersand that begins no whole entity stays as it is, as in pages cut within one."""
    return "".join("&" if k % 2 else text(x) for k, x in enumerate(_OPEN.split(raw)))


def start_tag(name: str, raw: str) -> tuple[str, bool]:
    """A start tag without its last bracket, with the attributes that stay, and whether a line above marks it as a sum."""
    own = attributes(raw)
    line = "border-top" in (own.get("style") or "").lower()
    own["class"] = _classes(own.get("class")) or ("secsum" if line else "")
    kept = [f'{k}="{text(own[k]).replace(chr(34), "&quot;")}"' for k in KEPT if own.get(k)]
    if name in ALIGNED and (to := alignment(own)):
        kept.append(f'style="text-align:{text(to)}"')
    return " ".join([f"<{name}", *kept]), line


_short_tag = lru_cache(4096)(start_tag)


def _token(token: str) -> tuple[str, str | None, str, str | None, str | None]:
    end, name, own, comment, marked = TOKEN.fullmatch(token).groups()
    return end, name and name.lower(), own, comment, marked


_short_token = lru_cache(4096)(_token)


class _Places:
    """Where something begins in a text, found when it is first asked for."""

    def __init__(self, s: str, pieces: list[str]):
        self.s, self.known = s, {}
        self.ends = list(accumulate(map(len, pieces)))[1::2]

    def after(self, tag: str, token: int) -> bool:
        """Whether a tag (its bracket, slash and name) begins after a token."""
        if tag not in self.known:
            self.known[tag] = max((m.start() for m in re.finditer(rf"{re.escape(tag)}(?=[\s>/])", self.s, re.I)), default=-1)
        return self.known[tag] >= self.ends[token]


class _Asks(Exception):
    """What a tag becomes depends on more than the tags."""


def _walk(tokens: tuple[str, ...], images: bool, after: Callable[[str, int], bool]) -> tuple[list[str], list[int], str, dict[str, int]]:
    """What each token becomes, the texts that are left out, what closes the rest, and what was found.

    Text k stands before token k.
    """
    made: list[str] = []
    hidden: list[int] = []
    stack: list[str] = []
    open_: dict[str, list[int]] = {}
    found = {"images": 0, "subtotal_marks": 0}
    skip: tuple[str, str] | None = None  # the tag that ends what is left out
    depth = 0

    def nearest(names: tuple[str, ...]) -> int:
        best = -1
        for n in names:
            if (x := open_.get(n)) and x[-1] > best:
                best = x[-1]
        return best

    def outermost(names: tuple[str, ...], bound: int) -> int | None:
        """The place of the first open element of some names after a bound."""
        best = None
        for n in names:
            if (x := open_.get(n)) and x[-1] > bound:
                k = x[bisect_right(x, bound)]
                best = k if best is None or k < best else best
        return best

    def closed(to: int) -> str:
        out = []
        while len(stack) > to:
            name = stack.pop()
            open_[name].pop()
            out.append(f"</{name}>")
        return "".join(out)

    for at, token in enumerate(tokens):
        made.append("")
        if skip:
            hidden.append(at)
        end, name, own, comment, marked = (_short_token if len(token) < SHORT else _token)(token)
        if name is None:
            if skip:
                continue
            if comment is not None:
                comment = re.sub("-(?=-)", "- ", _ILLEGAL.sub("", comment))
                made[at] = f"<!--{comment}{' ' if comment.endswith('-') else ''}-->"
            elif marked is not None:
                made[at] = text(marked.replace("&", "&amp;"))
            continue
        empty = own.endswith("/")
        if skip:
            if name == skip[1]:
                depth += -1 if end == skip[0] else name in DROPPED and not empty
                skip = skip if depth else None
            continue
        if end:
            if name == "text" and after("</document", at):
                skip, depth = ("/", "document"), 1
            elif name not in VOID and open_.get(name):
                bound = -1 if name == "table" else nearest(("table",) if name in PARTS else BOUNDS)
                if open_[name][-1] > bound:
                    made[at] = closed(open_[name][-1])
            continue
        if name == "document" and after("<text", at):
            skip, depth = ("", "text"), 1
            continue
        if name in DROPPED:
            if not empty and after(f"</{name}", at):
                skip, depth = ("/", name), 1
            continue
        tag, line = (_short_tag if len(own) < SHORT else start_tag)(name, own) if own else (f"<{name}", False)
        found["subtotal_marks"] += line
        if name in UNWRAPPED or ":" in name:
            continue
        if name == "img":
            found["images"] += 1
            if not images:
                continue
        ends = ""
        if name in IMPLIED:
            names, bounds = IMPLIED[name]
            if (first := outermost(names, nearest(bounds))) is not None:
                ends = closed(first)
        if empty or name in VOID:
            made[at] = f"{ends}{tag}/>"
        else:
            made[at] = f"{ends}{tag}>"
            open_.setdefault(name, []).append(len(stack))
            stack.append(name)
    if skip:
        hidden.append(len(tokens))
    return made, hidden, closed(0), found


@lru_cache(512)
def _kept_walk(tokens: tuple[str, ...], images: bool) -> tuple[list[str], list[int], str, dict[str, int]] | None:
    """The walk over tokens, or None where it depends on the places of texts."""

    def after(tag: str, token: int) -> bool:
        raise _Asks

    try:
        return _walk(tokens, images, after)
    except _Asks:
        return None


def balanced(raw: str, images: bool = True, loose: bool = False) -> tuple[str, dict[str, int]]:
    """Well-formed markup, and the numbers of images and subtotal_marks (elements with a line above).

    images: whether they stay; loose: whether ampersands that begin no whole entity do, which XML forbids.
    """
    s = without(without(raw.replace("\ufeff", ""), "script"), "style")
    for opener, closer, to in (("<!--", "-->", "&lt;!--"), ("<![CDATA[", "]]>", "")):
        if opener in s:
            last = max(0, s.rfind(closer))
            s = s[:last] + s[last:].replace(opener, to)  # what is not closed is no comment
    cut = s.rfind(">") + 1
    pieces = _SPLIT.split(s[:cut])
    pieces[-1] += s[cut:]
    tokens = tuple(pieces[1::2])
    walk = _kept_walk(tokens, images) if len(tokens) <= KEPT_TAGS and sum(map(len, tokens)) <= KEPT_CHARS else None
    made, hidden, rest, found = walk or _walk(tokens, images, _Places(s, pieces).after)
    pieces[1::2] = made
    for k in hidden:
        pieces[2 * k] = ""
    if _ODD.search("".join(pieces[::2])):
        pieces[::2] = map(loose_text if loose else text, pieces[::2])
    return "".join(pieces) + rest, dict(found)
