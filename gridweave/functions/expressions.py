"""``evaluate``: C-like expressions over grids, as Spark columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions import numeric as N
from gridweave.grid import FLOAT, KEYS, Grid

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)[fF]?|([A-Za-z_]\w*)|(&&|\|\||[<>=!]=|[-+*/%<>!?:(),]))")
_CALLS = {
    "abs": F.abs, "fabs": F.abs, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "log": N.logarithm, "log2": lambda v: N.logarithm(v, F.log2),
    "log10": lambda v: N.logarithm(v, F.log10), "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil, "round": F.round, "rint": F.rint, "trunc": N.truncate, "sign": F.signum,
    "min": N.fmin, "fmin": N.fmin, "max": N.fmax, "fmax": N.fmax, "pow": F.pow, "power": F.pow, "fmod": N.remainder, "atan2": F.atan2, "hypot": F.hypot,
    "clamp": lambda v, a, b: N.fmin(N.fmax(v, a), b),
}


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read expression at {text[at:]!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return [*out, "", ""]


class _Parser:
    """Precedence climbing; comparisons and logic give 1 or 0."""

    LEVELS = [["||"], ["&&"], ["==", "!="], ["<", "<=", ">", ">="], ["+", "-"], ["*", "/", "%"]]

    def __init__(self, text: str) -> None:
        self.tokens, self.at = _tokens(text), 0
        self.names: list[str] = []

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def peek(self) -> str:
        return self.tokens[self.at]

    def expect(self, token: str) -> None:
        if self.next() != token:
            raise ValueError(f"{token!r} expected in expression")

    def parse(self, env) -> Column:
        out = self.choice(env)
        self.expect("")
        return out

    def choice(self, env) -> Column:
        test = self.level(0, env)
        if self.peek() != "?":
            return test
        self.next()
        yes = self.choice(env)
        self.expect(":")
        return F.when(test != 0, yes).otherwise(self.choice(env))

    def level(self, n: int, env) -> Column:
        if n == len(self.LEVELS):
            return self.unary(env)
        a = self.level(n + 1, env)
        while self.peek() in self.LEVELS[n]:
            a = self.apply(self.next(), a, self.level(n + 1, env))
        return a

    @staticmethod
    def apply(op: str, a: Column, b: Column) -> Column:
        if op in "+-*" and len(op) == 1:
            return {"+": a + b, "-": a - b, "*": a * b}[op]
        if op == "/":
            return N.divide(a, b)
        if op == "%":
            return N.remainder(a, b)
        if op == "!=":
            return F.lit(1.0) - N.truth(a == b, a, b)
        tests = {"==": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
        if op in tests:
            return N.truth(tests[op], a, b)
        return F.when((a != 0) & (b != 0) if op == "&&" else (a != 0) | (b != 0), 1.0).otherwise(0.0)

    def unary(self, env) -> Column:
        token = self.next()
        if token == "-":
            return -self.unary(env)
        if token == "+":
            return self.unary(env)
        if token == "!":
            return F.when(self.unary(env) == 0, 1.0).otherwise(0.0)
        if token == "(":
            out = self.choice(env)
            self.expect(")")
            return out
        if re.match(r"[\d.]", token):
            return F.lit(float(token))
        if self.peek() == "(" and token in _CALLS:
            self.next()
            args = [self.choice(env)]
            while self.peek() == ",":
                self.next()
                args.append(self.choice(env))
            self.expect(")")
            return _CALLS[token](*args).cast("double")
        if not re.match(r"[A-Za-z_]", token):
            raise ValueError(f"unexpected {token!r} in expression")
        if token not in self.names:
            self.names.append(token)
        return env(token)


def variables(expression: str) -> list[str]:
    """Names in the order of their first use."""
    parser = _Parser(expression)
    parser.parse(lambda name: F.lit(0.0))
    return parser.names


def evaluate(expression: str, params: list[Grid | float], dtype: str | None = None) -> Grid:
    """Evaluates an expression; its names stand for ``params`` in the order of their first use.

    At least one parameter is a grid, and all grids have the same number of voxels.
    """
    names = variables(expression)
    if len(names) != len(params):
        raise ValueError(f"{len(names)} names for {len(params)} parameters")
    grids = {n: p for n, p in zip(names, params, strict=True) if isinstance(p, Grid)}
    if not grids:
        raise ValueError("an expression needs a grid")
    first = next(iter(grids.values()))
    if any(g.size != first.size for g in grids.values()):
        raise ValueError("grids differ in size")
    rows = [g.df.select(g.linear().alias("_i"), *(KEYS if g is first else []), F.col("v").alias(f"_{n}")) for n, g in grids.items()]
    joined = reduce(lambda a, b: a.join(b, "_i"), rows)
    env = {n: F.col(f"_{n}") if isinstance(p, Grid) else F.lit(float(p)) for n, p in zip(names, params, strict=True)}
    v = _Parser(expression).parse(env.__getitem__)
    return Grid(joined.select(*KEYS, v.alias("v")), first.shape, FLOAT).map(F.col("v"), dtype or FLOAT)
