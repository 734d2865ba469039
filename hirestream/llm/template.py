"""A small sandboxed template language for chat formats, compiled to closures.

``{{ value }}`` writes, ``{% for x in xs %}``, ``{% if c %}/{% elif %}/{% else %}``,
``{% set x = v %}`` and ``{% generation %}`` are blocks; ``-`` inside a tag trims white
space outside it. Values are literals, names, ``a.key``, ``a[key]``, ``a if c else b``,
``and or not``, comparisons, ``in``, ``+ - * % ~`` and filters ``a | name(args)``.

The sandbox has no calls and no Python attributes: ``.key`` looks a key up in a mapping
and nothing else, and filters come from a fixed table. A template is parsed into a
syntax tree, constants are folded, and the tree is turned into nested Python functions
once; rendering runs those only.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template does not parse, or asks for something that the sandbox lacks."""


# ------------------------------------------------------------------ syntax tree
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Write:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set_:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# ------------------------------------------------------------------ parsing
_TAG = re.compile(r"(\{\{-?|\{%-?)(.*?)(-?\}\}|-?%\})", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z][A-Za-z0-9_]*)|(==|!=|<=|>=|[-+*%~<>|.,()\[\]=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_WORDS = {"true": True, "false": False, "none": None}
_RESERVED = {"and", "or", "not", "in", "if", "else"}


class _Expr:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str):
        self.toks, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:at + 20]!r}")
            num, string, word, sign = m.groups()
            if num is not None:
                self.toks.append(("const", int(num)))
            elif string is not None:
                self.toks.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[0]), string[1:-1], flags=re.S)))
            else:
                self.toks.append(("word", word) if word else ("sign", sign))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.toks) and self.toks[self.at][0] != "const" and self.toks[self.at][1] in values

    def eat(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.eat(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.toks) and self.toks[self.at][0] == "word" and self.toks[self.at][1] not in _RESERVED:
            self.at += 1
            return self.toks[self.at - 1][1]
        raise TemplateError("a name is expected")

    def whole(self):
        out = self.choice()
        self.end()
        return out

    def end(self) -> None:
        if self.at != len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.at][1]!r}")

    def choice(self):
        value = self.either()
        if self.eat("if"):
            test = self.either()
            other = self.choice() if self.eat("else") else Const("")
            return Op("if", (test, value, other))
        return value

    def either(self):
        left = self.both()
        while self.eat("or"):
            left = Op("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.eat("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self):
        return Op("not", (self.negated(),)) if self.eat("not") else self.compared()

    def compared(self):
        left = self.joined()
        while True:
            if sign := self.eat("==", "!=", "<=", ">=", "<", ">", "in"):
                left = Op(sign, (left, self.joined()))
            elif self.eat("not"):
                self.need("in")
                left = Op("not", (Op("in", (left, self.joined())),))
            else:
                return left

    def joined(self):
        left = self.summed()
        while self.eat("~"):
            left = Op("~", (left, self.summed()))
        return left

    def summed(self):
        left = self.product()
        while sign := self.eat("+", "-"):
            left = Op(sign, (left, self.product()))
        return left

    def product(self):
        left = self.filtered()
        while sign := self.eat("*", "%"):
            left = Op(sign, (left, self.filtered()))
        return left

    def filtered(self):
        value = self.single()
        while self.eat("|"):
            name, args = self.name(), [value]
            if self.eat("("):
                while not self.eat(")"):
                    args.append(self.choice())
                    if not self.peek(")"):
                        self.need(",")
            value = Filter(name, tuple(args))
        return value

    def single(self):
        if self.eat("("):
            value = self.choice()
            self.need(")")
        elif self.at < len(self.toks) and self.toks[self.at][0] == "const":
            value = Const(self.toks[self.at][1])
            self.at += 1
        else:
            name = self.name()
            value = Const(_WORDS[name]) if name in _WORDS else Name(name)
        while True:
            if self.eat("."):
                value = Get(value, Const(self.name()))
            elif self.eat("["):
                value = Get(value, self.choice())
                self.need("]")
            else:
                return value


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of nodes."""
    pieces, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at:m.start()]
        text = text.lstrip() if trim else text
        pieces.append(("text", text.rstrip() if m[1].endswith("-") else text))
        if (m[1][:2] == "{{") != m[3].endswith("}}"):
            raise TemplateError(f"tag {m[0]!r} is not closed as it was opened")
        pieces.append(("write" if m[1].startswith("{{") else "tag", m[2].strip()))
        trim, at = m[3].startswith("-"), m.end()
    tail = source[at:]
    pieces.append(("text", tail.lstrip() if trim else tail))
    pos = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal pos
        nodes = []
        while pos < len(pieces):
            kind, body = pieces[pos]
            pos += 1
            if kind == "text":
                if body:
                    nodes.append(Write(Const(body)))
                continue
            if kind == "write":
                nodes.append(Write(_Expr(body).whole()))
                continue
            word, _, rest = body.partition(" ")
            if word in ends:
                return tuple(nodes), body
            if word == "for":
                e = _Expr(rest)
                name = e.name()
                e.need("in")
                nodes.append(For(name, e.whole(), block("endfor")[0]))
            elif word == "if":
                nodes.append(branch(rest))
            elif word == "set":
                e = _Expr(rest)
                name = e.name()
                e.need("=")
                nodes.append(Set_(name, e.whole()))
            elif word == "generation":
                nodes.append(Generation(block("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {body!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    def branch(rest: str) -> If:
        then, end = block("elif", "else", "endif")
        word, _, more = end.partition(" ")
        if word == "elif":
            return If(_Expr(rest).whole(), then, (branch(more),))
        return If(_Expr(rest).whole(), then, block("endif")[0] if word == "else" else ())

    return block()[0]


# ------------------------------------------------------------------ meaning of values
def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in (b or ()), "+": lambda a, b: a + b,
    "-": lambda a, b: a - b, "*": lambda a, b: a * b, "%": lambda a, b: a % b, "~": lambda a, b: _text(a) + _text(b),
}


class Escaper:
    """Reversible escapes: a backslash before every control string and every backslash."""

    def __init__(self, controls: Sequence[str]):
        longest = sorted(controls, key=len, reverse=True)
        for a in controls:
            for b in controls:
                if any(b.startswith(a[i:]) for i in range(1, len(a))) or "\\" in a:
                    raise TemplateError("control strings must not overlap or hold a backslash")
        self._put = re.compile("|".join([r"\\", *map(re.escape, longest)]))
        self._take = re.compile(r"\\(.)", re.S)
        self.token = re.compile("|".join([r"\\.", *map(re.escape, longest)]), re.S)

    def escape(self, text: str) -> str:
        return self._put.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._take.sub(lambda m: m[1], text)


def filters(controls: Sequence[str] = ()) -> dict[str, Callable]:
    """The filters that templates may name."""
    table: dict[str, Callable] = {"trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(),
                                  "lower": lambda v: _text(v).lower(), "length": lambda v: len(v or ""),
                                  "default": lambda v, d="": d if v is None else v,
                                  "replace": lambda v, a, b: _text(v).replace(a, b)}
    if controls:
        e = Escaper(controls)
        table["escape"] = lambda v: e.escape(_text(v))
    return table


# ------------------------------------------------------------------ constant folding
def fold(node: Any, known: Mapping[str, Callable]) -> Any:
    """The node with every part that needs no data replaced by its value."""
    if isinstance(node, tuple):
        out: list = []
        for n in node:
            n = fold(n, known)
            for x in n if isinstance(n, tuple) else (n,):
                if isinstance(x, Write) and isinstance(x.value, Const):
                    text = _text(x.value.value)
                    if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                        out[-1] = Write(Const(out[-1].value.value + text))
                    elif text:
                        out.append(Write(Const(text)))
                else:
                    out.append(x)
        return tuple(out)
    if isinstance(node, Write):
        return Write(fold(node.value, known))
    if isinstance(node, Set_):
        return Set_(node.name, fold(node.value, known))
    if isinstance(node, Generation):
        return Generation(fold(node.body, known))
    if isinstance(node, For):
        return For(node.name, fold(node.over, known), fold(node.body, known))
    if isinstance(node, If):
        test = fold(node.test, known)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, known)
        return If(test, fold(node.then, known), fold(node.other, known))
    if isinstance(node, Get):
        node = Get(fold(node.of, known), fold(node.key, known))
        return Const(_get(node.of.value, node.key.value)) if isinstance(node.of, Const) and isinstance(node.key, Const) else node
    if isinstance(node, (Op, Filter)):
        args = tuple(fold(a, known) for a in node.args)
        if isinstance(node, Filter):
            if node.name not in known:
                raise TemplateError(f"unknown filter {node.name!r}")
            node = Filter(node.name, args)
        else:
            node = Op(node.sign, args)
            if node.sign == "if" and isinstance(args[0], Const):
                return args[1] if args[0].value else args[2]
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(_value(node, known)({}))
            except Exception as e:  # a constant that cannot be computed is the template's fault
                raise TemplateError(f"constant expression fails: {e}") from e
    return node


# ------------------------------------------------------------------ closures
class Output:
    """Rendered text so far, with the code-point spans written under ``generation``."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []
        self.depth = 0

    def write(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if self.depth:
                if self.spans and self.spans[-1][1] == self.size:
                    self.spans[-1] = (self.spans[-1][0], self.size + len(text))
                else:
                    self.spans.append((self.size, self.size + len(text)))
            self.size += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        out = "".join(self.parts), self.spans
        self.parts, self.size, self.spans = [], 0, []
        return out


def _value(node: Any, known: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Get):
        of, key = _value(node.of, known), _value(node.key, known)
        return lambda env: _get(of(env), key(env))
    if isinstance(node, Filter):
        f, args = known[node.name], [_value(a, known) for a in node.args]
        if len(args) == 1:
            first = args[0]
            return lambda env: f(first(env))
        return lambda env: f(*(a(env) for a in args))
    args = [_value(a, known) for a in node.args]
    if node.sign == "not":
        return lambda env: not args[0](env)
    if node.sign == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.sign == "or":
        return lambda env: args[0](env) or args[1](env)
    if node.sign == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    f, (left, right) = _BINARY[node.sign], args
    return lambda env: f(left(env), right(env))


def _turns(items: Iterable) -> Iterator[tuple[Any, dict]]:
    """Items with what ``loop`` says of them, reading one item ahead."""
    index, it = 0, iter(items)
    for item in it:
        break
    else:
        return
    while True:
        following = next(it, _END)
        yield item, {"index0": index, "index": index + 1, "first": index == 0, "last": following is _END}
        if following is _END:
            return
        item, index = following, index + 1


_END = object()


def _block(nodes: tuple, known: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    steps = [_step(n, known) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Output) -> None:
        for s in steps:
            s(env, out)
    return run


def _step(node: Any, known: Mapping[str, Callable]) -> Callable[[dict, Output], None]:
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda env, out: out.write(text)
        value = _value(node.value, known)
        return lambda env, out: out.write(_text(value(env)))
    if isinstance(node, Set_):
        value, name = _value(node.value, known), node.name

        def put(env: dict, out: Output) -> None:
            env[name] = value(env)
        return put
    if isinstance(node, If):
        test, then, other = _value(node.test, known), _block(node.then, known), _block(node.other, known)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    if isinstance(node, Generation):
        body = _block(node.body, known)

        def mark(env: dict, out: Output) -> None:
            out.depth += 1
            body(env, out)
            out.depth -= 1
        return mark
    over, name, inner = _value(node.over, known), node.name, _block(node.body, known)

    def loop(env: dict, out: Output) -> None:
        for item, state in _turns(over(env) or ()):
            inner({**env, name: item, "loop": state}, out)
    return loop


@dataclass
class Program:
    """A compiled template."""
    tree: tuple
    known: Mapping[str, Callable]
    steps: list = field(init=False)

    def __post_init__(self) -> None:
        self.steps = [(n, _value(n.over, self.known), _block(n.body, self.known)) if isinstance(n, For)
                      else (n, None, _step(n, self.known)) for n in self.tree]

    def segments(self, values: Mapping[str, Any], limit: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Text and generation spans, in pieces cut after a turn of an outermost loop
        once they hold ``limit`` characters; at least one piece. A loop's items may be an
        iterator, which is read once and never held."""
        env, out, any_yet = dict(values), Output(), False
        for node, over, run in self.steps:
            if over is None:
                run(env, out)
                continue
            for item, state in _turns(over(env) or ()):
                run({**env, node.name: item, "loop": state}, out)
                if out.size >= limit:
                    any_yet = True
                    yield out.take()
        if out.size or not any_yet:
            yield out.take()

    def render(self, values: Mapping[str, Any]) -> tuple[str, list[tuple[int, int]]]:
        return next(self.segments(values, 1 << 62))


def compile_template(source: str, controls: Sequence[str] = ()) -> Program:
    known = filters(controls)
    return Program(fold(parse(source), known), known)
