"""Text inside markup: tags and attributes, plain text, widths, amounts, presentation."""

from __future__ import annotations

import html as _html
import re
from functools import lru_cache

#: Attributes and classes that stay, elements whose tags go, elements dropped whole, void elements,
#: elements that may be aligned, named entities, characters that count as blanks, and dashes that stand for nothing.
KEPT = ("colspan", "rowspan", "class", "href", "id", "src", "alt")
CLASSES = ("secsum",)
UNWRAPPED = ("font", "span", "center", "html", "head", "body")
DROPPED = ("script", "style", "head", "title", "ix:header", "ix:hidden", "xbrli:context", "xbrli:unit")
VOID = ("br", "hr", "img", "col", "wbr", "input", "meta", "link", "area", "base", "embed", "source", "track", "param")
ALIGNED = ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "col", "colgroup")
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "minus": "−", "times": "×", "hellip": "…", "rsquo": "’", "lsquo": "‘", "rdquo": "”", "ldquo": "“"}
BLANKS = "      ​"
DASHES = ("—", "–", "-")
_BLANK = dict.fromkeys(map(ord, BLANKS), " ")

#: A tag; quoted attribute values may hold brackets.  SPLIT deals markup into texts and tags by turns.
TAG = re.compile(r"""<(/?)([A-Za-z][\w:.-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
SPLIT = re.compile(r"""(</?[A-Za-z][\w:.-]*+(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>)""")
_ATTRIBUTE = re.compile(r"""([\w:.-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def attributes(text: str) -> dict[str, str | None]:
    """The attributes of a tag by lower-case names; the first of equal names counts, a bare one has no value."""
    out: dict[str, str | None] = {}
    for m in _ATTRIBUTE.finditer(text.rstrip("/ ")):
        out.setdefault(m[1].lower(), m[m.lastindex] if m.lastindex > 1 else None)
    return out


def _entity(m: re.Match) -> str:
    digits, hexes, name = m.groups()
    if name:
        return ENTITIES.get(name.lower(), "")
    if len(digits or hexes) > 9:
        return ""
    n = int(digits) if digits else int(hexes, 16)
    return chr(n) if 32 <= n <= 0x10FFFF and not 0xD800 <= n < 0xE000 else ""


_TAGGED, _ENTITY = re.compile("<[^<>]*+>"), re.compile(r"&#([0-9]++);|&#[xX]([0-9A-Fa-f]++);|&([A-Za-z]++);")


def plain_text(html: str) -> str:
    """The text without tags, entities decoded (unknown named ones go), blanks of any kind in a row as one."""
    t = _TAGGED.sub(" ", html) if "<" in html else html
    if "&" in t:
        t = _ENTITY.sub(_entity, t)
    return " ".join((t if t.isascii() else t.translate(_BLANK)).split())


@lru_cache(4096)
def _width(c: str) -> float:
    if c == " ":
        return 0.28
    if c in ",.'":
        return 0.25
    if c.isascii():
        return 0.66 if "A" <= c <= "Z" else 0.5
    return 1.0 if len(c.encode()) > 2 else 0.6


def text_width(text: str) -> float:
    """About how wide a text is, in em."""
    return sum(map(_width, text))


def token_width(text: str) -> float:
    """The width of its widest part without a blank: it cannot get narrower."""
    return max(map(text_width, text.split()), default=0.0)


_MONEY, _NUMBER = re.compile(r"[$\s%]"), re.compile(r"\(?[-–—]?[0-9,.]+\)?")


def is_numeric(text: str) -> bool:
    """A number as statements print it: with currency, percent, parentheses or a sign; or a lone dash."""
    x = _MONEY.sub("", text)
    return x in DASHES or _NUMBER.fullmatch(x) is not None


def is_amount(text: str) -> bool:
    """A number of over four digits: a sum, not a year or a note."""
    return len(text) > 4 and sum(map(str.isdigit, text)) > 4 and is_numeric(text)


_LETTER = re.compile("[A-Za-z\x80-\U0010ffff]")


def has_letters(text: str) -> bool:
    return _LETTER.search(text) is not None


#: All digits are alike to what is asked of a cell, and so are all small letters.
_SHAPE = bytes.maketrans(b"123456789bcdefghijklmnopqrstuvwxyz", b"0" * 9 + b"a" * 25)


@lru_cache(1 << 14)
def _traits(shape: bytes) -> tuple[float, bool, bool, bool]:
    text = shape.decode("utf-8", "surrogatepass")
    return token_width(text), is_numeric(text), is_amount(text), has_letters(text)


def traits(text: str) -> tuple[float, bool, bool, bool]:
    """token_width, is_numeric, is_amount and has_letters of a text; short texts of one shape are looked at once."""
    if len(text) < 40:
        return _traits(text.encode("utf-8", "surrogatepass").translate(_SHAPE))
    return token_width(text), is_numeric(text), is_amount(text), has_letters(text)


_HIDING = [
    (re.compile(r"color\s*:\s*(?:#fff(?:fff)?|white|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))\s*(?=[;\"'>]|$)", re.I), ""),
    (re.compile(r"font-size\s*:\s*(?:[0-5](?:\.\d*)?|\.\d+)(?![\d.])[^;\"'>]*", re.I), ""),
    (re.compile(r"line-height\s*:\s*0+(?:\.0*)?(?![\d.])[^;\"'>]*", re.I), ""),
    (re.compile(r"display\s*:\s*none\s*;?|visibility\s*:\s*hidden\s*;?", re.I), ""),
    (re.compile(r"color\s*=\s*[\"']?(?:#?ffffff|white)[\"']?", re.I), ""),
    (re.compile(r"(?<!\s)\s++style\s*=\s*[\"'][\s;]*+[\"']", re.I), ""),
]


def unhidden(html: str) -> str:
    """Markup without the styles that hide text: white, under 6 points, no line height, not displayed."""
    for pattern, to in _HIDING:
        html = pattern.sub(to, html)
    return html


def _classes(value: str | None) -> str:
    return " ".join(dict.fromkeys(c for c in (value or "").lower().split() if c in CLASSES))


def subtotals(html: str) -> tuple[str, int]:
    """Markup whose elements with a line above (border-top) have the class secsum, and how many there are."""
    n = 0

    def mark(m: re.Match) -> str:
        nonlocal n
        own = attributes(m[3])
        if m[1] or "border-top" not in (own.get("style") or "").lower():
            return m[0]
        n += 1
        if "secsum" in (own.get("class") or "").lower().split():
            return m[0]
        if "class" in own:
            value = f"{own['class'] or ''} secsum".strip()
            return re.sub(r"""\bclass(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>/]+))?""", f'class="{value}"', m[0], count=1, flags=re.I)
        return f'<{m[2]} class="secsum"{m[3]}>'

    return TAG.sub(mark, html), n


def alignment(own: dict[str, str | None]) -> str | None:
    found = re.search(r"text-align\s*:\s*([A-Za-z-]+)", own.get("style") or "")
    to = found[1] if found else own.get("align") or ""
    return to if to != "left" and re.fullmatch("[A-Za-z-]+", to) else None


def plain_tags(html: str) -> str:
    """Markup with only the attributes that stay; tags that only change the look go, void elements are closed."""

    def rebuilt(m: re.Match) -> str:
        name = m[2].lower()
        if name in UNWRAPPED or ":" in name:
            return ""
        if m[1]:
            return "" if name in VOID else f"</{m[2]}>"
        own = attributes(m[3])
        own["class"] = _classes(own.get("class"))
        kept = [f'{k}="{(own[k] or "").replace(chr(34), "&quot;")}"' for k in KEPT if own.get(k)]
        if name in ALIGNED and (to := alignment(own)):
            kept.append(f'style="text-align:{to}"')
        return f"<{' '.join([m[2], *kept])}{'/' if name in VOID or m[3].rstrip().endswith('/') else ''}>"

    return TAG.sub(rebuilt, html)


def without(html: str, name: str) -> str:
    """Markup without the elements of a name, nested ones included; an element that is not closed goes to the end."""
    if f"<{name}" not in html.lower():
        return html
    out, depth, at = [], 0, 0
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s>/])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>", html, re.I):
        if not depth and not m[1]:
            out.append(html[at : m.start()])
        if not m[0].endswith("/>"):
            depth = max(0, depth + (-1 if m[1] else 1))
        if not depth:
            if m[1] and at > m.start():
                continue
            at = m.end()
    if not depth:
        out.append(html[at:])
    return "".join(out)


def clean(raw: str, images: bool = True, loose: bool = False, **wide) -> tuple[str, dict[str, int]]:
    """A filing's markup for reading, and what was found: images, subtotal_marks, tables, split, subtables, kept, collapsed.

    Well-formed for any input, unless loose lets ampersands stay that begin no whole entity; cleaning the result again changes nothing in it.  Prologue, scripts,
    styles, the submission's envelope, inline data, document tags, hiding styles and presentation go,
    images if unwanted; then wide tables are cut into parts.
    """
    from sedimenta.functions.balance import balanced
    from sedimenta.functions.tables import split_wide

    s, found = balanced(raw, images, loose)
    s, more = split_wide(s, **wide)
    return s, found | more


def unescaped(text: str) -> str:
    return _html.unescape(text)
