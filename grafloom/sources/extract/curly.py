"""Declarations of languages with classes in braces, found by bracket matching."""

from __future__ import annotations

from dataclasses import dataclass

from .facts import dotted, matches, skip_generic, tokens

#: Words before a bracket that call nothing.
NO_CALL = frozenset("if for while switch catch return new throw else do try synchronized sizeof typeof nameof using lock foreach when function super this await yield delete case in of instanceof assert default base".split())

_MEMBER_STOPS = frozenset(("(", "{", ";", "=", "=>", "}"))


@dataclass(slots=True)
class Type:
    kind: str
    name: str
    line: int
    bases: list[tuple[str, str]]  # (clause, name)
    body: tuple[int, int]


@dataclass(slots=True)
class Member:
    kind: str  # function, field, block
    name: str
    type: str
    line: int
    end: int
    body: tuple[int, int]


class Reader:
    """Types and members of a source whose comments and literals are blank."""

    def __init__(self, clean: str, kinds: frozenset[str], access: tuple[str, ...] = (".", "::")):
        (self.toks, self.lines, self.words), self.access = tokens(clean), access
        self.count = len(self.toks)
        self.close = matches(self.toks)
        self.kinds = kinds

    def text(self, i: int) -> str:
        return self.toks[i] if 0 <= i < self.count else ""

    def type_at(self, i: int, end: int) -> Type | None:
        """The type declared by the keyword at i."""
        t, words = self.toks, self.words
        if self.text(i) not in self.kinds or i + 1 >= end or not words[i + 1] or self.text(i - 1) == ".":
            return None
        kind, j = t[i], i + 1
        if t[j] in self.kinds:  # enum class, record struct
            j += 1
        name = t[j]
        j = skip_generic(t, j + 1)
        if self.text(j) == "(":
            j = self.close[j] + 1
        bases, clause = [], ""
        while j < end and t[j] not in "{;":
            if t[j] == "where":  # constraints name no bases
                while j < end and t[j] not in "{;":
                    j += 1
            elif t[j] in ("extends", "implements", ":", "permits", "final"):
                clause = t[j]
                j += 1
            elif words[j] and t[j] not in ("public", "private", "protected", "virtual"):
                base, j = dotted(t, self.words, j)
                while self.text(j) == "::":
                    base, j = dotted(t, self.words, j + 1)
                j = skip_generic(t, j)
                if clause in ("extends", "implements", ":"):
                    bases.append((clause, base))
                j = self.close[j] + 1 if self.text(j) == "(" else j
            else:
                j += 1
        if self.text(j) != "{":
            return None
        return Type(kind, name, self.lines[i], bases, (j + 1, self.close[j]))

    def members(self, start: int, end: int):
        """Types and members directly in a body, in order."""
        t, kinds, i = self.toks, self.kinds, start
        while i < end:
            if t[i] in ";}," or t[i] == "{":
                i = self.close[i] + 1 if t[i] == "{" else i + 1
                continue
            if t[i] == "@" and i + 1 < end and t[i + 1] != "interface":
                _, i = dotted(t, self.words, i + 1)
                i = self.close[i] + 1 if self.text(i) == "(" else i
                continue
            if t[i] == "[":
                i = self.close[i] + 1
                continue
            j, type_ = i, None
            while j < end and t[j] not in _MEMBER_STOPS:
                if t[j] in kinds and (type_ := self.type_at(j, end)) is not None:
                    break
                j = max(skip_generic(t, j), j + 1) if t[j] == "<" else j + 1
            if type_ is not None:
                yield type_
                i = type_.body[1] + 1
                continue
            yield from (found := self._member(i, j, end))
            i = self._after(j, end, bool(found))

    def _word_before(self, j: int, low: int) -> int:
        k = j - 1
        if k >= low and self.text(k) == ">":  # generic parameters of a method
            depth = 0
            while k >= low:
                depth += {">": 1, "<": -1}.get(self.text(k), 0)
                k -= 1
                if depth == 0:
                    break
        while k >= low and not self.words[k]:
            k -= 1
        return k

    def _body_after(self, j: int, end: int) -> tuple[int, int] | None:
        """The braces or arrow body that follow a parameter list; None if it is only declared."""
        j = self.close.get(j, j) + 1
        while j < end and self.text(j) not in ("{", ";", "=>", "="):
            j = self.close[j] + 1 if self.text(j) == "(" else j + 1
        if self.text(j) == "{":
            return j + 1, min(self.close[j], end)
        if self.text(j) == "=>":
            k = j
            while k < end and self.text(k) != ";":
                k = self.close[k] + 1 if self.text(k) in ("(", "{", "[") else k + 1
            return j + 1, k
        return None

    def _after(self, j: int, end: int, _found: bool) -> int:
        t = self.toks
        if self.text(j) == "(":
            j = self.close[j] + 1
        while j < end and t[j] not in ("{", ";", "}"):
            j = self.close[j] + 1 if t[j] in ("(", "[") else j + 1
        if self.text(j) == "{":
            j = min(self.close[j], end) + 1
            if self.text(j) == "=":  # a property with a value
                while j < end and t[j] != ";":
                    j = self.close[j] + 1 if t[j] in ("(", "{", "[") else j + 1
            return j
        return j + 1

    def _member(self, i: int, j: int, end: int) -> list[Member]:
        t, lines, words, stop = self.toks, self.lines, self.words, self.text(j)
        k = self._word_before(j, i)
        if k < i:
            return []
        name, line = t[k], lines[k]
        if stop == "(":
            if name in NO_CALL:
                return []
            body = self._body_after(j, end)
            last = min(body[1] if body else self.close[j], len(t) - 1)
            return [Member("function", name, "", line, lines[last], body or (j, j))]
        if k == i and stop in ("{", "=>"):
            return []
        kind = self._type_text(i, k)
        found = [Member("property" if stop in ("{", "=>") else "field", name, kind, line, line, (j, j))]
        depth_end = j
        while stop in ("=", ";", "") and depth_end < end and t[depth_end] != ";":  # int a = f(), b;
            if t[depth_end] == "," and depth_end + 1 < end and words[depth_end + 1]:
                found.append(Member("field", t[depth_end + 1], kind, lines[depth_end + 1], lines[depth_end + 1], (j, j)))
            depth_end = self.close[depth_end] + 1 if t[depth_end] in ("(", "{", "[") else depth_end + 1
        if stop == ";":  # int a, b;
            names = [m for m in range(i, j) if t[m] == "," and words[m - 1] and words[m + 1] and "<" not in t[i:m]]
            for m in names:
                found.append(Member("field", t[m - 1], kind, lines[m - 1], lines[m - 1], (j, j)))
        return found

    def _type_text(self, i: int, k: int) -> str:
        """The type in front of a name: its last dotted word outside generics."""
        out, m = "", i
        while m < k:
            if self.words[m]:
                out, m = dotted(self.toks, self.words, m)
                m = skip_generic(self.toks, m)
            else:
                m += 1
        return out

    def calls(self, start: int, end: int):
        """(kind, scope, name) of calls: new, scoped (one identifier before the dot), chained, plain."""
        t, words, count = self.toks, self.words, self.count
        for i in range(start, min(end, count)):
            if not words[i]:
                continue
            after = t[i + 1] if i + 1 < count else ""
            if after != "(" and after != "<" and t[i] != "new":
                continue
            before = self.text(i - 1)
            if t[i] == "new" and i + 1 < end and words[i + 1]:
                name, j = dotted(t, self.words, i + 1)
                if self.text(skip_generic(t, j)) in ("(", "[", "{"):
                    yield "new", "", name
                continue
            j = skip_generic(t, i + 1) if after == "<" else i + 1
            if self.text(j) != "(" or t[i] in NO_CALL or before == "new":
                continue
            if before in self.access:
                head = i - 2
                single = head >= start and words[head] and self.text(head - 1) not in self.access
                made = self.text(head - 1) == "new"
                if not made:
                    yield ("scoped" if single else "chained"), (t[head] if single else ""), t[i]
            else:
                yield "plain", "", t[i]
