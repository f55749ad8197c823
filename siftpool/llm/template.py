"""A small sandboxed template language for chat formats: parsed to a tree, constants folded, compiled to closures.

    {{ expr }}   {% if e %}..{% elif e %}..{% else %}..{% endif %}   {# remark #}
    {% for x in e %}..{% endfor %}   {% generation %}..{% endgeneration %}

Expressions have strings, whole numbers, true, false, none, names, x.key and
x[expr], + ~ (joins as text), == != < <= > >= in, not, and, or, and filters
after a bar. Only values that the caller passes can be named, only keys of
mappings and items of lists reached, and only the filters below called.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any, NamedTuple

#: Strings that mean something in a formatted conversation.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
DEPTH, SIZE = 50, 100_000


class TemplateError(ValueError):
    """The template can't be parsed, or reaches for what it may not."""


def escape(text: str) -> str:
    """Text in which no control string stands: backslashes are doubled, and one is put after a control string's first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _text(x: Any) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
    "string": _text,
}


def _key(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and type(key) is int:
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"no {key!r} in a {type(of).__name__}")


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "+": lambda a, b: a + b if type(a) is type(b) and isinstance(a, (int, str)) else _text(a) + _text(b),
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


class Node(NamedTuple):
    """kind and parts: text, const, name, key, binary, not, and, or, filter, out, if, for, generation, block."""

    kind: str
    parts: tuple = ()


# --- parsing

_SPLIT = re.compile(r"(\{%-?.*?-?%\}|\{\{-?.*?-?\}\}|\{#.*?#\})", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>|.()\[\]]))""", re.DOTALL)
_STRING = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, end = [], 0, len(source.rstrip())
    while at < end:
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing over the tokens of one expression."""

    LEVELS = (("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "~"))

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at, self.depth = tokens, 0, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *want: str) -> str | None:
        got = self.peek()
        if got in want:
            self.at += 1
            return got
        return None

    def need(self, what: str) -> None:
        if not self.take(what):
            raise TemplateError(f"{what} is missing")

    def whole(self) -> Node:
        out = self.level(0)
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def level(self, k: int) -> Node:
        self.depth += 1
        if self.depth > DEPTH * len(self.LEVELS):
            raise TemplateError("too deep")
        try:
            if k == len(self.LEVELS):
                return self.filtered()
            if self.LEVELS[k] == ("not",):
                return Node("not", (self.level(k),)) if self.take("not") else self.level(k + 1)
            left = self.level(k + 1)
            while op := self.take(*self.LEVELS[k]):
                right = self.level(k + 1)
                left = Node(op, (left, right)) if op in ("and", "or") else Node("binary", (op, left, right))
            return left
        finally:
            self.depth -= 1

    def filtered(self) -> Node:
        out = self.postfix()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            out = Node("filter", (name, out))
        return out

    def postfix(self) -> Node:
        out = self.atom()
        while True:
            if self.take("."):
                out = Node("key", (out, Node("const", (self.name(),))))
            elif self.take("["):
                out = Node("key", (out, self.level(0)))
                self.need("]")
            else:
                return out

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name" or text.startswith("_"):
            raise TemplateError(f"{text!r} is no name")
        self.at += 1
        return text

    def atom(self) -> Node:
        if self.take("("):
            out = self.level(0)
            self.need(")")
            return out
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, text = self.tokens[self.at]
        if kind == "str":
            self.at += 1
            return Node("const", (re.sub(r"\\(.)", lambda m: _STRING.get(m[1], m[1]), text[1:-1], flags=re.DOTALL),))
        if kind == "num":
            self.at += 1
            return Node("const", (int(text),))
        fixed = {"true": True, "false": False, "none": None}
        name = self.name()
        return Node("const", (fixed[name],)) if name in fixed else Node("name", (name,))


def parse(source: str) -> Node:
    """The template's syntax tree."""
    if len(source) > SIZE:
        raise TemplateError("too long")
    parts = [p for p in _SPLIT.split(source) if p and not p.startswith("{#")]
    at = 0

    def block(until: tuple[str, ...], depth: int) -> tuple[Node, str, str]:
        """Nodes up to a tag of until, that tag's word, and the rest of it."""
        nonlocal at
        if depth > DEPTH:
            raise TemplateError("too deep")
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                out.append(Node("out", (_Expression(_tokens(part[2:-2].strip("-"))).whole(),)))
            elif not part.startswith("{%"):
                out.append(Node("text", (part,)))
            else:
                word, _, rest = part[2:-2].strip("-").strip().partition(" ")
                if word in until:
                    return Node("block", tuple(out)), word, rest
                if word == "if":
                    arms, cond, ended = [], rest, ""
                    while ended != "endif":
                        test = _Expression(_tokens(cond)).whole() if ended != "else" else Node("const", (True,))
                        body, ended_next, cond = block(("endif",) if ended == "else" else ("elif", "else", "endif"), depth + 1)
                        arms.append((test, body))
                        ended = ended_next
                    out.append(Node("if", tuple(arms)))
                elif word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.DOTALL)
                    if not m:
                        raise TemplateError(f"can't read for {rest!r}")
                    body, _, _ = block(("endfor",), depth + 1)
                    out.append(Node("for", (m[1], _Expression(_tokens(m[2])).whole(), body)))
                elif word == "generation":
                    body, _, _ = block(("endgeneration",), depth + 1)
                    out.append(Node("generation", (body,)))
                else:
                    raise TemplateError(f"unexpected {word!r}")
        if until:
            raise TemplateError(f"{until[-1]} is missing")
        return Node("block", tuple(out)), "", ""

    return block((), 0)[0]


# --- folding


def fold(node: Node) -> Node:
    """The same template with constant expressions evaluated, dead arms gone and neighbouring texts joined."""
    kind, parts = node
    if kind in ("binary", "filter"):
        args = [fold(p) for p in parts[1:]]
        if all(a.kind == "const" for a in args):
            f = BINARY[parts[0]] if kind == "binary" else FILTERS[parts[0]]
            try:
                return Node("const", (f(*(a.parts[0] for a in args)),))
            except (TypeError, TemplateError):
                pass  # as it would fail in use
        return Node(kind, (parts[0], *args))
    if kind == "not":
        own = fold(parts[0])
        return Node("const", (not own.parts[0],)) if own.kind == "const" else Node("not", (own,))
    if kind in ("and", "or"):
        a, b = fold(parts[0]), fold(parts[1])
        if a.kind == "const":
            return b if bool(a.parts[0]) == (kind == "and") else a
        return Node(kind, (a, b))
    if kind == "key":
        return Node("key", tuple(fold(p) for p in parts))
    if kind == "out":
        own = fold(parts[0])
        return Node("text", (_text(own.parts[0]),)) if own.kind == "const" else Node("out", (own,))
    if kind == "if":
        arms = []
        for test, body in parts:
            test = fold(test)
            if test.kind == "const" and not test.parts[0]:
                continue
            arms.append((test, fold(body)))
            if test.kind == "const":
                break
        if arms and arms[0][0].kind == "const":
            return arms[0][1]
        return Node("if", tuple(arms)) if arms else Node("block")
    if kind == "for":
        return Node("for", (parts[0], fold(parts[1]), fold(parts[2])))
    if kind == "generation":
        return Node("generation", (fold(parts[0]),))
    if kind == "block":
        out: list[Node] = []
        for p in map(fold, parts):
            for q in p.parts if p.kind == "block" else (p,):
                if q.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", (out[-1].parts[0] + q.parts[0],))
                elif q != Node("text", ("",)):
                    out.append(q)
        return Node("block", tuple(out))
    return node


# --- closures

Chunk = tuple[str, bool]  # text, and whether it is generated


def _value(node: Node) -> Callable[[dict], Any]:
    kind, parts = node
    if kind == "const":
        return lambda scope, x=parts[0]: x
    if kind == "name":
        return lambda scope, name=parts[0]: scope.get(name)
    if kind == "key":
        of, key = map(_value, parts)
        return lambda scope: _key(of(scope), key(scope))
    if kind == "binary":
        f, a, b = BINARY[parts[0]], _value(parts[1]), _value(parts[2])
        return lambda scope: f(a(scope), b(scope))
    if kind == "filter":
        f, a = FILTERS[parts[0]], _value(parts[1])
        return lambda scope: f(a(scope))
    if kind == "not":
        a = _value(parts[0])
        return lambda scope: not a(scope)
    a, b = map(_value, parts)
    return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))


def _writer(node: Node, generated: bool = False) -> Callable[[dict], Iterator[Chunk]]:
    kind, parts = node
    if kind == "text":
        return lambda scope, chunk=(parts[0], generated): iter((chunk,))
    if kind == "out":
        value = _value(parts[0])
        return lambda scope: iter(((_text(value(scope)), generated),))
    if kind == "generation":
        return _writer(parts[0], True)
    if kind == "block":
        own = [_writer(p, generated) for p in parts]

        def block(scope):
            for w in own:
                yield from w(scope)

        return block
    if kind == "if":
        arms = [(_value(test), _writer(body, generated)) for test, body in parts]

        def choose(scope):
            for test, body in arms:
                if test(scope):
                    yield from body(scope)
                    return

        return choose
    name, items, body = parts[0], _value(parts[1]), _writer(parts[2], generated)

    def loop(scope):
        todo = iter(items(scope) or ())
        now, k = next(todo, None), 0
        while now is not None:
            follow = next(todo, None)
            yield from body(scope | {name: now, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": follow is None}})
            now, k = follow, k + 1

    return loop


def compiled(source: str) -> Callable[..., Iterator[Chunk]]:
    """render(name=value, ...) gives the chunks of the formatted text one by one; values that are iterators are read as they are needed."""
    write = _writer(fold(parse(source)))
    return lambda **scope: write(scope)
