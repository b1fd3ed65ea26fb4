"""A file of Java as declarations: one linear scanner for its tokens, and a reader of what they declare and call.

Every token is found once (the patterns never go back), brackets are paired in one pass, and each of them is skipped or entered at most a few
times, so the work is linear in the file, whatever its literals, comments or depth. Nothing is resolved here: names come out as
they are written, for joins to resolve. The body of a method is first read by itself, and what it calls is remembered by its text: of bodies that
repeat (getters, delegates, generated code) only the ends are looked for. So is what stands between two bodies, if it declares one method and nothing
else: such a method is one token.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cached_property

#: What is skipped, and the token after it (empty at the end of the text, so that nothing skipped is tried again).
_TOKEN = re.compile(
    r"""(?:\s++|//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?)*+
    ("{3}[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+(?:"{3})?|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?
    |'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?
    |(?:[^\W\d]|\$)[\w$]*+
    |\d[\w.]*+
    |->|::|\.\.\.|.
    |\Z)""",
    re.X | re.S,
)

#: What a search for brackets steps over at once: other text, comments and literals, which are those of _TOKEN.
_OVER = r"""[^{}()"'/]++|//[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/)?|/
    |"{3}[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+(?:"{3})?|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"""
#: What stands before a body: parameters, and what is thrown.
_THROWS = r"\s*+(?:throws\s[\w$.,\s]*+)?+"
#: The text up to the next body's bracket (or the end).
_TO_BODY = re.compile(rf"(?:{_OVER}|[{{}}(]|\)(?!{_THROWS}\{{))*+(?:\){_THROWS})?+", re.X | re.S)


def _blocks(depth: int) -> str:
    return rf"\{{(?:{_OVER}|[()]{'|' + _blocks(depth - 1) if depth else ''})*+\}}"


#: A body whose blocks are at most ten deep.
_BODY = re.compile(_blocks(10), re.X | re.S)
#: Characters of bodies that are remembered, and of the longest of them.
_HELD, _LONGEST = 1 << 23, 1 << 15


class _Bodies(dict):
    """(calls, constants) of a body by its text; None if types may be declared in it, or its brackets do not pair."""

    size = 0

    def __missing__(self, text: str) -> tuple[list[dict], list[dict]] | None:
        r = Reader(text, whole=True)
        try:
            found = None if r.telling or any(r.word[j] != _OPEN[r.word[i]] for i, j in r.match.items()) else (r.calls(1, r.match[0]), r.constants())
        except IndexError:
            found = None
        if len(text) <= _LONGEST:
            self.size += len(text)
            if self.size > _HELD:
                self.clear()
                self.size = len(text)
            self[text] = found
        return found


_bodies = _Bodies()


class _Heads(dict):
    """The method that a text before a body declares in a type; None if that is not all it does."""

    size = 0

    def __missing__(self, text: str) -> dict | None:
        r = Reader(f"class A {{{text}{{}}}}", whole=True)
        word, t, todo = _tokens(text), {"fields": [], "methods": []}, []
        end = 3 + len(word) + 2
        found = None
        if r.word[:r.n] == ["class", "A", "{", *word, "{", "}", "}"] and r.telling == [0] and r.pairs():
            try:
                if r.member(3, end, t, todo) == end and len(t["methods"]) == 1 and not t["fields"] and todo == [(end - 1, end - 1)] and not r.constants():
                    found = t["methods"][0]
            except IndexError:
                pass
        if len(text) <= _LONGEST:
            self.size += len(text)
            if self.size > _HELD:
                self.clear()
                self.size = len(text)
            self[text] = found
        return found


_heads = _Heads()


class _Whole(Exception):
    """The tokens of a body are asked for."""


def _tokens(text: str, *at: int) -> list[str]:
    word = _TOKEN.findall(text, *at)
    while word and not word[-1]:
        word.pop()
    return word


class _Kinds(dict):
    """The kind of a token by its first character."""

    def __missing__(self, c: str) -> str:
        self[c] = kind = "string" if c == '"' else "char" if c == "'" else "number" if re.match(r"\d", c) else "word" if re.match(r"[\w$]", c) else "sign"
        return kind


_KIND = _Kinds()
MODIFIERS = frozenset("public protected private static final abstract default synchronized native transient volatile strictfp sealed non".split())
_KINDS = frozenset(("class", "interface", "enum", "record"))
#: Words before a name and a bracket that leave it a call, and words that are never called.
_BEFORE_CALL = frozenset("return throw else do case yield assert new instanceof in".split())
_NEVER = frozenset("if for while switch catch return super this synchronized throw new else try do case assert".split())
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
_BRACKETS = frozenset((*_OPEN, *_CLOSE))
#: The token that stands for a method.
_METHOD = "\0"
#: Words of which a part of a text must hold one for a package, an import or a type to be found in it.
_TELLING = _KINDS | {"package", "import"}


class Reader:
    """The declarations of one text. Unless it is read as a whole, bodies are two tokens, and what they hold is in `held`, by the first of these; or one, with
    the method that they are of in `ready`. Such methods must be met where a type's member is looked for, and nowhere else."""

    def __init__(self, text: str, whole: bool = False) -> None:
        self.held: dict[int, tuple[list[dict], list[dict]]] = {}
        self.ready: dict[int, dict] = {}
        self.met = 0
        self.word = word = _tokens(text) if whole else self.split(text)
        self.bodies = list(self.held)
        self.n = len(word)
        self.kind = [_KIND[w[0]] for w in word]
        # where each bracket is closed (at the end, if it never is)
        self.match, stack = {}, []
        for i in [i for i, w in enumerate(word) if w in _BRACKETS]:
            w = word[i]
            if w in _OPEN:
                stack.append(i)
            else:
                while stack and word[stack[-1]] != _CLOSE[w] and w == "}":
                    self.match[stack.pop()] = i
                if stack and word[stack[-1]] == _CLOSE[w]:
                    self.match[stack.pop()] = i
        for i in stack:
            self.match[i] = self.n
        self.kind += ["end"] * 4
        self.word += [""] * 4
        self.telling = [i for i, w in enumerate(word) if w in _TELLING]
        self.package, self.imports, self.types = "", [], []

    @cached_property
    def called(self) -> list[int]:
        """Brackets after names."""
        return [i for i, w in enumerate(self.word) if w == "(" and i and self.kind[i - 1] == "word" and self.word[i - 1] not in _NEVER]

    def split(self, text: str) -> list[str]:
        """The tokens of a text, but for those of its bodies."""
        word: list[str] = []
        start = at = 0
        while (open_ := _TO_BODY.match(text, at).end()) < len(text) and text[open_] == "{":
            body = _BODY.match(text, open_)
            if not body:
                break
            at = body.end()
            held = _bodies[body.group()]
            if held is None:
                continue
            head = _heads[text[start:open_]] if start else None
            if head:
                self.held[len(word)] = held
                self.ready[len(word)] = {**head, "calls": held[0]}
                word.append(_METHOD)
            else:
                word += _tokens(text, start, open_)
                self.held[len(word)] = held
                word += "{", "}"
            start = at
        word += _tokens(text, start)
        return word

    def pairs(self) -> bool:
        """Whether all brackets pair."""
        return all(j < self.n and self.word[j] == _OPEN[self.word[i]] for i, j in self.match.items()) and 2 * len(self.match) == sum(w in _BRACKETS for w in self.word)

    def known(self, i: int, end: int) -> None:
        """Makes sure that no token between two others is a body's."""
        k = bisect_left(self.bodies, i)
        if k < len(self.bodies) and self.bodies[k] < end:
            raise _Whole

    def tells(self, i: int, end: int) -> bool:
        """Whether a type or an import may stand between two tokens."""
        k = bisect_left(self.telling, i)
        return k < len(self.telling) and self.telling[k] < end

    def past(self, i: int) -> int:
        """After the bracket that opens at i."""
        return self.match.get(i, i) + 1

    def literal(self, i: int) -> str:
        w = self.word[i]
        return w[3:-3] if w.startswith('"""') and len(w) > 5 else w[1:-1] if len(w) > 1 and w[-1] == '"' else w[1:]

    def name(self, i: int) -> tuple[str, int]:
        """A dotted name from i on."""
        out = [self.word[i]]
        i += 1
        while self.word[i] == "." and self.kind[i + 1] == "word":
            out.append(self.word[i + 1])
            i += 2
        return ".".join(out), i

    def angles(self, i: int) -> int:
        """After the type arguments that open at i."""
        depth = 0
        while i < self.n:
            w = self.word[i]
            if w == "<":
                depth += 1
            elif w == ">":
                depth -= 1
                if not depth:
                    return i + 1
            elif w in (";", "{", "}"):
                return i
            i = self.past(i) if w == "(" else i + 1
        return i

    def type(self, i: int) -> tuple[str, int]:
        """A type as its name without arguments and dimensions, from i on."""
        out = []
        while True:
            while self.word[i] == "@":
                _, i = self.annotation(i)
            if self.kind[i] != "word":
                break
            part, i = self.name(i)
            out.append(part)
            if self.word[i] == "<":
                i = self.angles(i)
            if self.word[i] != "." or self.kind[i + 1] != "word":
                break
            i += 1
        while self.word[i] in ("[", "...") or self.word[i] == "@":
            i = self.past(i) if self.word[i] == "[" else self.annotation(i)[1] if self.word[i] == "@" else i + 1
        return ".".join(out), i

    def types_until(self, i: int, ends: tuple[str, ...]) -> tuple[list[str], int]:
        out = []
        while i < self.n and self.word[i] not in ends:
            name, j = self.type(i)
            if name:
                out.append(name)
            i = max(j, i + 1) if not name else j
            if self.word[i] in (",", "&"):
                i += 1
        return out, i

    def values(self, i: int, end: int) -> list[tuple[bool, str]]:
        """The literals and names between two tokens: (is a literal, its text); literals that are added up are one."""
        self.known(i, end)
        out, plus = [], False
        while i < end:
            w, k = self.word[i], self.kind[i]
            if k == "string":
                if plus and out and out[-1][0]:
                    out[-1] = (True, out[-1][1] + self.literal(i))
                else:
                    out.append((True, self.literal(i)))
            elif k == "word":
                name, j = self.name(i)
                out.append((False, name))
                i = j - 1
            elif k == "number":
                out.append((False, w))
            elif w == "@":
                i = self.annotation(i)[1] - 1
            plus = w == "+"
            i += 1
        return out

    def annotation(self, i: int) -> tuple[dict, int]:
        """An annotation from its @ on: its name, and (attribute, "" where none is named; literal; value) of each value."""
        name, i = self.name(i + 1)
        args = []
        if self.word[i] == "(":
            end, i = self.match[i], i + 1
            while i < end:
                key = ""
                if self.kind[i] == "word" and self.word[i + 1] == "=" and self.word[i + 2] != "=":
                    key, i = self.word[i], i + 2
                j = i
                while j < end and self.word[j] != ",":
                    j = self.past(j) if self.word[j] in _OPEN else j + 1
                args += [{"name": key, "literal": lit, "value": v} for lit, v in self.values(i, j)]
                i = j + 1
            i = end + 1
        return {"name": name.rsplit(".", 1)[-1], "args": args}, i

    def head(self, i: int) -> tuple[list[dict], list[str], int]:
        """(annotations, modifiers, what follows) from i on."""
        notes, mods = [], []
        while True:
            if self.word[i] == "@" and self.word[i + 1] != "interface" and self.kind[i + 1] == "word":
                note, i = self.annotation(i)
                notes.append(note)
            elif self.kind[i] == "word" and self.word[i] in MODIFIERS and self.word[i + 1] not in ("(", ":", "->", ".", "="):
                mods.append(self.word[i])
                i += 3 if self.word[i] == "non" and self.word[i + 1] == "-" else 1
            else:
                return notes, mods, i

    def declares(self, i: int) -> bool:
        """Whether a type is declared at i (its head is read)."""
        return self.kind[i] == "word" and self.word[i] in _KINDS and self.kind[i + 1] == "word" and self.word[i + 2] in ("<", "{", "extends", "implements", "permits", "(") or self.word[i] == "@" and self.word[i + 1] == "interface"

    def file(self) -> None:
        """Reads the whole text; types (nested ones too) come in the order in which they stand."""
        todo: list[tuple[int, int]] = [(0, self.n)]
        while todo:
            i, end = todo.pop()
            if not self.tells(i, end):
                continue
            while i < end:
                start = i
                notes, mods, i = self.head(i)
                if self.word[i] == "package" and self.kind[i + 1] == "word" and not self.types:
                    self.package, i = self.name(i + 1)
                elif self.word[i] == "import" and self.kind[i + 1] == "word":
                    static = self.word[i + 1] == "static" and self.kind[i + 2] == "word"
                    path, i = self.name(i + 1 + static)
                    if self.word[i] == "." and self.word[i + 1] == "*":
                        path, i = f"{path}.*", i + 2
                    self.imports.append((path, static))
                elif self.declares(i):
                    i = self.declaration(start, i, notes, mods, todo)
                else:
                    i = max(i, start) + 1
        if self.met != len(self.ready):
            raise _Whole
        self.types.sort(key=lambda t: t["at"])

    def declaration(self, at: int, i: int, notes: list[dict], mods: list[str], todo: list[tuple[int, int]]) -> int:
        """Reads the type declared at i; ranges with types inside go to todo. Returns what follows it."""
        kind = "annotation" if self.word[i] == "@" else self.word[i]
        i += 1 if kind != "annotation" else 2
        t = {"at": at, "name": self.word[i], "kind": kind, "annotations": notes, "modifiers": mods, "extends": [], "implements": [], "fields": [], "methods": []}
        i += 1
        if self.word[i] == "<":
            i = self.angles(i)
        if kind == "record" and self.word[i] == "(":
            i = self.past(i)
        while i < self.n and self.word[i] != "{" and self.word[i] not in (";", "}"):
            clause = self.word[i]
            if clause in ("extends", "implements", "permits"):
                found, i = self.types_until(i + 1, ("extends", "implements", "permits", "{", ";", "}"))
                if clause != "permits":
                    t[clause] += found
            else:
                i += 1
        if self.word[i] != "{":
            return i
        if i in self.held:  # of a record
            raise _Whole
        self.types.append(t)
        end = self.match[i]
        i += 1
        if kind == "enum":
            while i < end and self.word[i] != ";":
                if self.word[i] == "{":
                    todo.append((i + 1, self.match[i]))
                i = self.past(i) if self.word[i] in _OPEN else i + 1
        while i < end:
            i = self.member(i, end, t, todo)
        return end + 1

    def member(self, i: int, end: int, t: dict, todo: list[tuple[int, int]]) -> int:
        start = i
        if i in self.ready:
            t["methods"].append(self.ready[i])
            self.met += 1
            return i + 1
        if i - 1 in self.held and self.word[i - 1] == "{":  # after brackets that do not pair
            raise _Whole
        notes, mods, i = self.head(i)
        if self.declares(i):
            todo.append((start, self.skipped(i, end)))
            return self.skipped(i, end)
        if self.word[i] == "{":  # an initializer
            todo.append((i + 1, self.match[i]))
            return self.past(i)
        if self.word[i] == "<":
            i = self.angles(i)
        if self.kind[i] != "word":
            return i + 1
        kind, i = self.type(i)
        if self.kind[i] == "word" and self.word[i + 1] == "(":
            name, i = self.word[i], i + 1
            params, i = self.parameters(i), self.past(i)
            method = {"name": name, "return_type": kind, "parameters": params, "annotations": notes, "modifiers": mods, "calls": []}
            t["methods"].append(method)
        elif self.kind[i] == "word":
            return self.declarators(i, end, {"type": kind, "annotations": notes, "modifiers": mods}, t, todo)
        elif self.word[i] == "(":  # a constructor
            method, i = None, self.past(i)
        else:
            return max(i, start + 1)
        while i < end and self.word[i] not in ("{", ";"):
            i += 1
        if self.word[i] == "{" and i < end:
            if method:
                method["calls"] = self.held[i][0] if i in self.held else self.calls(i + 1, self.match[i])
            todo.append((i + 1, self.match[i]))
            return self.past(i)
        return i + 1

    def skipped(self, i: int, end: int) -> int:
        """After the declaration at i."""
        while i < end and self.word[i] not in ("{", ";"):
            i = self.past(i) if self.word[i] == "(" else i + 1
        return self.past(i) if self.word[i] == "{" else i + 1

    def parameters(self, i: int) -> list[dict]:
        out, end = [], self.match[i]
        i += 1
        while i < end:
            notes, _, i = self.head(i)
            kind, i = self.type(i)
            name = self.word[i] if self.kind[i] == "word" else ""
            if kind and name and name != "this":
                out.append({"type": kind, "name": name, "annotations": notes})
            while i < end and self.word[i] != ",":
                i = self.past(i) if self.word[i] in _OPEN else i + 1
            i += 1
        return out

    def declarators(self, i: int, end: int, field: dict, t: dict, todo: list[tuple[int, int]]) -> int:
        """Reads the names that a field's declaration gives, with their initial value if it is a literal."""
        while i < end and self.kind[i] == "word":
            one = {"name": self.word[i], "value": None, **field}
            t["fields"].append(one)
            i += 1
            while self.word[i] == "[":
                i = self.past(i)
            if self.word[i] == "=":
                first = i = i + 1
                while i < end and self.word[i] not in (",", ";"):
                    if self.word[i] == "{":
                        todo.append((i + 1, self.match[i]))
                    if self.word[i] == "new" and self.kind[i + 1] == "word":
                        i = max(self.type(i + 1)[1], i + 1)
                    else:
                        i = self.past(i) if self.word[i] in _OPEN else self.angles(i) if self.word[i] == "<" and self.word[i - 1] == "." else i + 1
                found = self.values(first, i)
                if self.kind[first] == "string" and len(found) == 1:
                    one["value"] = found[0][1]
            if self.word[i] != ",":
                break
            i += 1
        return i + 1

    def calls(self, i: int, end: int) -> list[dict]:
        """The calls between two tokens: qualifier (null after a call or literal), callee, and first argument."""
        self.known(i, end)
        out, types = [], self.tells(i, end)
        at = bisect_left(self.called, i + 1)
        while at < len(self.called):
            k, i = i, self.called[at] - 1
            if i >= end:
                break
            if types:
                while k <= i and not (self.declares(k) and self.word[k - 1] != "."):
                    k += 1
                if k <= i:
                    i = self.skipped(k, end)  # a local type, read as one
                    at = bisect_left(self.called, i + 1)
                    continue
            at, w = at + 1, self.word[i]
            names, k = [], i
            while self.word[k - 1] == "." and self.kind[k - 2] == "word":
                k -= 2
                names.append(self.word[k])
            names.reverse()
            before, after = self.word[k - 1], self.word[self.match[i + 1] + 1]
            header = (self.kind[k - 1] == "word" and before not in _BEFORE_CALL or before in (">", "]")) and not names and (after == "{" or after == "throws")
            if before not in ("new", "@") and not header and names[:1] != ["super"]:
                if names and names[0] == "this" and len(names) > 1:
                    names = names[1:]
                if before == ".":  # what another call gives
                    names = []
                j = i + 2
                lit = self.kind[j] == "string"
                arg = self.literal(j) if lit else self.name(j)[0] if self.kind[j] in ("word", "number") else None
                out.append({"qualifier": ".".join(names) or None, "callee": w, "literal": lit, "argument": arg})
            i += 1
        return out

    def constants(self) -> list[dict]:
        """Every String of the text that is given a literal, wherever it is declared."""
        w, k, out = self.word, self.kind, []
        for i in [i for i, x in enumerate(w) if x == "String" or i in self.held]:
            if i in self.held:
                out += self.held[i][1]
            elif k[i + 1] == "word" and w[i + 2] == "=" and k[i + 3] == "string":
                out.append({"name": w[i + 1], "value": self.literal(i + 3)})
        return out


def read(text: str) -> Reader:
    try:
        out = Reader(text)
        out.file()
    except (_Whole, IndexError, RecursionError):
        out = Reader(text, whole=True)
        out.file()
    return out
