"""URLs in documents: resolving against a base, and the parts of a URL."""

from __future__ import annotations

import re

from fathom.functions.scalar import html_decode_text

#: Schemes that are never resolved: fixed values.
OPAQUE = ("mailto:", "javascript:")

_ABSOLUTE = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*:")
_PARTS = re.compile(r"(?:([a-zA-Z][\w+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?", re.S)

#: Attribute that holds the URL, by tag; href for all others: fixed values.
URL_ATTRIBUTE = {"img": "src", "image": "src", "frame": "src", "iframe": "src", "script": "src", "embed": "src", "form": "action", "object": "data"}


def resolve(url: str | None, base: str | None) -> str:
    """A URL as a page with this base means it; its entities are decoded first."""
    url = html_decode_text((url or "").strip())
    if not base or _ABSOLUTE.match(url) or url.lower().startswith(OPAQUE):
        return url
    scheme, host, path, query, _ = _PARTS.match(base).groups()
    root = f"{scheme}://{host}" if scheme else ""
    if url.startswith("//"):
        return f"{scheme or 'http'}:{url}"
    if url.startswith("/"):
        return root + url
    if url.startswith("#"):
        return root + path + (query or "") + url
    if url.startswith("?"):
        return root + path + url
    if not url:
        return base
    folder = path[: path.rfind("/") + 1] or "/"
    while url.startswith(("./", "../")):
        if url.startswith("../"):
            folder = folder[: folder.rstrip("/").rfind("/") + 1] or "/"
        url = url.split("/", 1)[1]
    return root + folder + url


def host_name(url: str | None) -> str:
    return (_PARTS.match(url or "")[2] or "").rsplit("@", 1)[-1].split(":")[0]


def domain_name(url: str | None) -> str:
    return ".".join(host_name(url).split(".")[-2:])


def path_name(url: str | None) -> str:
    return _PARTS.match(url or "")[3] or ""


def protocol(url: str | None) -> str:
    return (_PARTS.match(url or "")[1] or "").lower()
