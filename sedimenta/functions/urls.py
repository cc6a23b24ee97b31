"""References in documents: resolving them, and what a file is by its name or its first bytes."""

from __future__ import annotations

import re

#: Schemes that are no files, kinds of images by their endings, and the ending of each kind.
REFUSED = [("data:", "data-uri"), ("javascript:", "javascript"), ("blob:", "blob"), ("mailto:", "mailto")]
KINDS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "jpe": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
ENDINGS = {"image/jpeg": "jpg", "image/png": "png", "image/gif": "gif", "image/webp": "webp", "image/svg+xml": "svg", "image/bmp": "bmp", "image/tiff": "tiff"}
#: Host names from which images are taken, subdomains included.
HOSTS = ("sec.gov",)
#: Bytes of a file that sniff() needs.
HEAD = 2048

_SCHEME = re.compile(r"[A-Za-z][\w+.-]*(?=://)")


def clean_path(path: str) -> str:
    """A path without fragment, empty, . and .. parts (never above the root); a query stays."""
    path, _, query = path.partition("#")[0].partition("?")
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/" + "/".join(out) + (f"?{query}" if query else "")


def base_of(url: str | None) -> tuple[str, str, str] | None:
    """Scheme, host and path (without query) of a document's URL; None if it is none."""
    m = re.fullmatch(r"([A-Za-z][\w+.-]*)://([^/]+)(/.*)?", url or "", re.DOTALL)
    return (m[1], m[2], re.split("[?#]", m[3] or "/")[0]) if m else None


def resolve(base: str | None, ref: str | None) -> tuple[str | None, str | None]:
    """(absolute URL without fragment, None), or (None, why there is none)."""
    if ref is None:
        return None, "no-src"
    ref = ref.strip()
    if not ref or ref[0] == "#":
        return None, "fragment" if ref else "empty"
    for scheme, why in REFUSED:
        if ref.lower().startswith(scheme):
            return None, why
    if _SCHEME.match(ref):
        return ref.partition("#")[0], None
    own = base_of(base)
    if ref.startswith("//"):
        return f"{own[0] if own else 'https'}:{ref.partition('#')[0]}", None
    if not own:
        return None, "no-base"
    folder = "" if ref[0] == "/" else own[2].rpartition("/")[0] + "/"
    return f"{own[0]}://{own[1]}{clean_path(folder + ref)}", None


def host_allowed(url: str, hosts: tuple[str, ...] = HOSTS) -> bool:
    """Whether a URL's host, without port, is one of hosts or below one."""
    own = base_of(url)
    name = re.sub(r":[0-9]+$", "", own[1]).lower() if own else ""
    return any(name == h or name.endswith(f".{h}") for h in hosts)


def ending(url: str) -> str | None:
    """The ending of a URL's path, of two to five letters or digits."""
    m = re.search(r"\.([A-Za-z0-9]{2,5})$", re.split("[?#]", url)[0].lower())
    return m[1] if m else None


def _jpeg_size(head: bytes) -> tuple[int | None, int | None]:
    at = 2
    while at + 9 < len(head):
        mark = head[at + 1]
        if head[at] != 0xFF:
            at += 1
        elif mark in (0x01, 0xD8, *range(0xD0, 0xD8)):
            at += 2
        elif mark in (0xD9, 0xDA):
            break
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(head[at + 7 : at + 9]), int.from_bytes(head[at + 5 : at + 7])
        else:
            at += 2 + int.from_bytes(head[at + 2 : at + 4])
    return None, None


def sniff(head: bytes | None) -> tuple[str, int | None, int | None] | None:
    """Kind, width and height of an image by its first bytes; None if it is none."""
    if not head or len(head) < 8:
        return None
    size = lambda a, b, n, order: (int.from_bytes(head[a : a + n], order), int.from_bytes(head[b : b + n], order)) if len(head) >= b + n else (None, None)
    if head.startswith(b"\xff\xd8\xff"):
        return "image/jpeg", *_jpeg_size(head)
    if head.startswith(b"\x89PNG\r\n\x1a\n"):
        return "image/png", *size(16, 20, 4, "big")
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return "image/gif", *size(6, 8, 2, "little")
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        return "image/webp", None, None
    if head[:2] == b"BM":
        return "image/bmp", *size(18, 22, 4, "little")
    if head[:4] in (b"II*\0", b"MM\0*"):
        return "image/tiff", None, None
    low = head.lower()
    return ("image/svg+xml", None, None) if low.startswith(b"<svg") or low.startswith(b"<?xml") and b"<svg" in low else None
