"""Band algebra: expressions over bands become Spark columns.

Operators by rising precedence: comparisons (1.0 or 0.0), ``+ -``, ``* /``, unary minus. Division adds 1e-6 to the divisor.
Functions: and, or, not, if, between, clamp, min, max. Null pixels (nodata) give null in arithmetic, comparisons, ``and``, ``not``,
``if`` (any argument) and ``between``. ``min``, ``max``, ``or`` (the larger) and ``clamp`` leave null arguments out, as the minimum and
maximum of floating-point numbers do; they are null only if all arguments are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6
_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<op>[<>=!]=|[-+*/<>(),]))")
_BINARY = {"<": 1, ">": 1, "<=": 1, ">=": 1, "==": 1, "!=": 1, "+": 2, "-": 2, "*": 3, "/": 3}


def _number(condition: Column) -> Column:
    return condition.cast("double")


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b + F.lit(EPSILON))


_APPLY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide, "<": lambda a, b: _number(a < b), ">": lambda a, b: _number(a > b),
    "<=": lambda a, b: _number(a <= b), ">=": lambda a, b: _number(a >= b), "==": lambda a, b: _number(a == b), "!=": lambda a, b: _number(a != b),
}
_FUNCTIONS = {
    "and": (2, lambda a, b: a * b), "or": (2, F.greatest), "not": (1, lambda a: 1.0 - a), "if": (3, lambda c, t, f: c * t + (1.0 - c) * f),
    "between": (3, lambda x, lo, hi: _number(x.between(lo, hi))), "clamp": (3, lambda x, lo, hi: F.greatest(lo, F.least(x, hi))), "min": (2, F.least), "max": (2, F.greatest),
}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str, bands: int, band_of):
        self.left, self.bands, self.band_of = tokens(text), bands, band_of

    def peek(self) -> str | None:
        return self.left[0][1] if self.left else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if not self.left:
            raise ValueError("the expression ends early")
        got = self.left.pop(0)
        if want is not None and got[1] != want:
            raise ValueError(f"expected {want!r}, found {got[1]!r}")
        return got

    def expression(self, least: int = 1) -> Column:
        left = self.operand()
        while (op := self.peek()) in _BINARY and _BINARY[op] >= least:
            self.take()
            left = _APPLY[op](left, self.expression(_BINARY[op] + 1))
        return left

    def operand(self) -> Column:
        kind, text = self.take()
        if kind == "num":
            return F.lit(float(text))
        if text == "-":
            return -self.operand()
        if text == "+":
            return self.operand()
        if text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind == "name" and re.fullmatch(r"[Bb]\d+", text) and self.peek() != "(":
            n = int(text[1:])
            if not 1 <= n <= self.bands:
                raise ValueError(f"band {text} is not among the {self.bands} bands")
            return self.band_of(n)
        if kind == "name" and text.lower() in _FUNCTIONS:
            size, apply = _FUNCTIONS[text.lower()]
            self.take("(")
            args = [self.expression()]
            while self.peek() == ",":
                self.take()
                args.append(self.expression())
            self.take(")")
            if len(args) != size:
                raise ValueError(f"{text} takes {size} arguments")
            return apply(*args)
        raise ValueError(f"unexpected {text!r}")


def compile_expression(text: str, bands: int, band_of=lambda n: F.col(f"b{n}")) -> Column:
    """The column of an expression over bands ``B1`` to ``B<bands>``; ``ValueError`` for anything else."""
    if not text.strip():
        raise ValueError("an empty expression")
    parser = _Parser(text, bands, band_of)
    out = parser.expression()
    if parser.left:
        raise ValueError(f"unexpected {parser.peek()!r}")
    return out
