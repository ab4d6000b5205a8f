"""What an extractor finds in a file, and the tokens it reads."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Facts:
    """Nodes and edges of one file, in the order found; an id's last node wins."""

    file: str
    nodes: dict[tuple[str, str], dict] = field(default_factory=dict)
    edges: dict[tuple[str, str, str], None] = field(default_factory=dict)

    def node(self, label: str, id: str, name: str, line: int, end: int | None = None, **props) -> str:
        self.nodes[label, id] = {"id": id, "label": label, "name": name, "file": self.file, "line": line, "start_line": line, "end_line": end or line} | props
        return id

    def edge(self, src: str, dst: str, type: str) -> None:
        self.edges[src, dst, type] = None

    def local(self, name: str) -> str:
        return f"{self.file}:{name}"


_BLANK = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?", re.S)
_TOKEN = re.compile(r"[A-Za-z_$][\w$]*|\d[\w.]*|::|->|=>|\+\+|--|[-+*/%&|^<>=!]=|&&|\|\||[^\s\w]")
_HEADS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_$")


def without_strings(source: str) -> str:
    """Comments and literals turned to blanks of the same shape."""

    def blank(m: re.Match) -> str:
        text = m[0]
        head = text[0] if text[0] in "\"'`" else " "
        return head + (" " * (len(text) - 1) if "\n" not in text else re.sub(r"[^\n]", " ", text[1:]))

    return _BLANK.sub(blank, source)


def tokens(clean: str) -> tuple[list[str], list[int], list[bool]]:
    """The texts of the tokens, their lines, and whether they are words, of a source whose comments and literals are blank."""
    texts, lines = [], []
    for line, text in enumerate(clean.split("\n"), 1):
        if found := _TOKEN.findall(text):
            texts += found
            lines += [line] * len(found)
    return texts, lines, [t[0] in _HEADS for t in texts]


PAIRS = {"(": ")", "{": "}", "[": "]"}
_BRACKETS = frozenset(PAIRS) | frozenset(PAIRS.values())


def matches(toks: list[str]) -> dict[int, int]:
    """Index of the bracket that closes each opening one; the end for those left open."""
    out, stack = {}, []
    for i, t in enumerate(toks):
        if t not in _BRACKETS:
            continue
        if t in PAIRS:
            stack.append(i)
        else:
            while stack:
                j = stack.pop()
                out[j] = i
                if PAIRS[toks[j]] == t:
                    break
    return dict.fromkeys(stack, len(toks)) | out


def skip_generic(toks: list[str], i: int) -> int:
    """After a <...> that starts at i; i itself if there is none."""
    if i >= len(toks) or toks[i] != "<":
        return i
    depth = 0
    for j in range(i, min(i + 200, len(toks))):
        t = toks[j]
        if t == "<":
            depth += 1
        elif t == ">":
            depth -= 1
        if depth == 0:
            return j + 1
        if t in ";{}":
            break
    return i


def dotted(toks: list[str], words: list[bool], i: int) -> tuple[str, int]:
    """A name with its dots from i on, and where it ends."""
    parts = []
    while i < len(toks) and words[i]:
        parts.append(toks[i])
        if i + 1 < len(toks) and toks[i + 1] == ".":
            i += 2
        else:
            return ".".join(parts), i + 1
    return ".".join(parts), i
