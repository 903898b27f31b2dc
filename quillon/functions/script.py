"""The scoring expression language, compiled to Column expressions.

Division and remainder by zero, unknown variables and values that aren't
finite are 0; a source that doesn't compile leaves ``_score`` as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_][\w.]*(?:\['\w+'\](?:\.value)?)?)|(&&|\|\||[<>=!]=|[-+*/%<>?:(),]))")
BINDING = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6}


class ScriptError(ValueError):
    pass


def number(c: Column) -> Column:
    """c as a double, 0 where it is null or not finite."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


BINARY = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.when(b == 0, 0.0).otherwise(F.try_divide(a, b)),
    "%": lambda a, b: F.when(b == 0, 0.0).otherwise(F.try_mod(a, b)),
    "<": lambda a, b: flag(a < b),
    "<=": lambda a, b: flag(a <= b),
    ">": lambda a, b: flag(a > b),
    ">=": lambda a, b: flag(a >= b),
    "==": lambda a, b: flag(a == b),
    "!=": lambda a, b: flag(a != b),
    "&&": lambda a, b: flag((a != 0) & (b != 0)),
    "||": lambda a, b: flag((a != 0) | (b != 0)),
}
FUNCTIONS = {
    "min": (2, lambda a, b: F.least(a, b)),
    "max": (2, lambda a, b: F.greatest(a, b)),
    "abs": (1, F.abs),
    "pow": (2, lambda a, b: number(F.pow(a, b))),
    "log": (1, lambda a: F.when(a > 0, F.log(F.when(a > 0, a).otherwise(1.0))).otherwise(0.0)),
    "log1p": (1, lambda a: F.when(a > -1, F.log1p(F.when(a > -1, a).otherwise(0.0))).otherwise(0.0)),
    "sqrt": (1, lambda a: F.when(a >= 0, F.sqrt(F.when(a >= 0, a).otherwise(0.0))).otherwise(0.0)),
    "round": (1, lambda a: F.floor(a + 0.5).cast("double")),
    "floor": (1, lambda a: F.floor(a).cast("double")),
    "ceil": (1, lambda a: F.ceil(a).cast("double")),
}


class _Parser:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise ScriptError(f"unexpected '{source[at]}' at {at}")
            kind = m.lastindex
            self.tokens.append((("", "number", "name", "sign")[kind], m[kind]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, wanted: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ScriptError("the expression ends early")
        token = self.tokens[self.at]
        if wanted is not None and token[1] != wanted:
            raise ScriptError(f"expected '{wanted}', not '{token[1]}'")
        self.at += 1
        return token

    def parse(self):
        tree = self.expression(0)
        if self.at < len(self.tokens):
            raise ScriptError(f"unexpected '{self.peek()}'")
        return tree

    def expression(self, least: int):
        left = self.primary()
        while (power := BINDING.get(self.peek(), 0)) > least:
            sign = self.take()[1]
            left = ("binary", sign, left, self.expression(power))
        if least == 0 and self.peek() == "?":
            self.take()
            yes = self.expression(0)
            self.take(":")
            left = ("if", left, yes, self.expression(0))
        return left

    def primary(self):
        kind, text = self.take()
        if kind == "number":
            return ("number", float(text))
        if kind == "name":
            if self.peek() == "(":
                if text not in FUNCTIONS:
                    raise ScriptError(f"unknown function '{text}'")
                self.take()
                given = []
                while self.peek() != ")":
                    given.append(self.expression(0))
                    if self.peek() != ")":
                        self.take(",")
                self.take(")")
                if len(given) != FUNCTIONS[text][0]:
                    raise ScriptError(f"{text} takes {FUNCTIONS[text][0]} arguments")
                return ("call", text, given)
            return ("name", re.sub(r"^doc(?:\.|\[')|'\]|\.value$", "", text))
        if text == "-":
            return ("minus", self.primary())
        if text == "+":
            return self.primary()
        if text == "(":
            inner = self.expression(0)
            self.take(")")
            return inner
        raise ScriptError(f"unexpected '{text}'")


@dataclass
class CompiledScript:
    source: str
    tree: tuple | None
    error: str | None = None

    def variables(self) -> list[str]:
        found: list[str] = []

        def walk(t):
            if isinstance(t, tuple):
                if t[0] == "name" and t[1] not in found:
                    found.append(t[1])
                for x in t[1:]:
                    walk(x)
            elif isinstance(t, list):
                for x in t:
                    walk(x)

        walk(self.tree)
        return found

    def column(self, columns: dict[str, Column]) -> Column:
        """The expression's value; columns has the variables, _score among them."""
        if self.tree is None:
            return columns["_score"]

        def of(t) -> Column:
            if t[0] == "number":
                return F.lit(t[1])
            if t[0] == "name":
                return number(columns[t[1]]) if t[1] in columns else F.lit(0.0)
            if t[0] == "minus":
                return -of(t[1])
            if t[0] == "if":
                return F.when(of(t[1]) != 0, of(t[2])).otherwise(of(t[3]))
            if t[0] == "call":
                return FUNCTIONS[t[1]][1](*map(of, t[2]))
            return BINARY[t[1]](of(t[2]), of(t[3]))

        return number(of(self.tree))


def describe() -> dict:
    """What the language has: functions with the number of their arguments, and operators with how strongly they bind."""
    return {"functions": {name: n for name, (n, _) in FUNCTIONS.items()}, "operators": dict(BINDING), "conditional": "a ? b : c"}


def compile_script(source: str) -> CompiledScript:
    try:
        return CompiledScript(source, _Parser(source).parse())
    except ScriptError as e:
        return CompiledScript(source, None, str(e))
