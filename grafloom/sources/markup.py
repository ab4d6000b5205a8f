"""Server-side code in markup: which language it is in, and the page with all else blanked out."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIRECTIVE = re.compile(r"<%@[^%]*?language\s*=\s*[\"']?([\w.#]+)", re.I)
_INLINE = re.compile(r"<%(?!@)=?(.*?)%>", re.S)
_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I)
#: Language names of directives.
_LANGUAGES = {"c#": "cs", "cs": "cs", "csharp": "cs", "vb": "vb", "vbscript": "vb", "vbs": "vb", "vb.net": "vb"}


def language(path: str, text: str) -> str:
    """``cs`` or ``vb``: by directive, else by extension."""
    found = _DIRECTIVE.search(text)
    if found and found[1].lower() in _LANGUAGES:
        return _LANGUAGES[found[1].lower()]
    return "vb" if path.lower().endswith(".asp") else "cs"


def server_code(text: str) -> str:
    """The text with everything but server-side code turned to spaces; line ends stay, so places survive."""
    keep = [m.span(1) for m in _INLINE.finditer(text)]
    keep += [m.span(2) for m in _SCRIPT.finditer(text) if re.search(r"runat\s*=\s*[\"']?server", m[1], re.I)]
    out = [c if c in "\r\n" else " " for c in text]
    for a, b in keep:
        out[a:b] = text[a:b]
    return "".join(out)


def script_bodies(html: Column | str) -> Column:
    """The bodies of a page's script elements."""
    c = F.col(html) if isinstance(html, str) else html
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(?s)<script[^>]*>(.*?)</script>"), 1)
