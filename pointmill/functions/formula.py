"""Arithmetic formulas over fields, compiled to Column expressions with IEEE semantics.

An expression reader keeps two stacks, of values still to be used and of operators still to be applied.
Functions take their arguments from the stack of values; what is left over or missing at the end is an
error. All errors are raised before any data is read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pointmill.errors import EngineError

_NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _d(x: float) -> Column:
    return F.lit(float(x))


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is infinite by the sign of x, 0/0 is NaN. Zero has no sign."""
    safe = a / F.when(b != 0.0, b)
    at_zero = F.when((a == 0.0) | F.isnan(a), _d(math.nan)).when(a > 0.0, _d(math.inf)).otherwise(_d(-math.inf))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(b != 0.0, safe).otherwise(at_zero))


def _log(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x > 0.0, fn(F.when(x > 0.0, x))).when(x == 0.0, _d(-math.inf)).when(x.isNotNull(), _d(math.nan))


def power(x: Column, y: Column) -> Column:
    """C's pow: 1 to any power is 1, and -1 to an infinite one."""
    infinite = (y == math.inf) | (y == -math.inf)
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when((x == 1.0) | ((x == -1.0) & infinite), _d(1.0)).otherwise(F.pow(x, y))


def _less(a: Column, b: Column) -> Column:
    """a < b as IEEE has it: never with a NaN."""
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


#: Arguments and meaning of each function.
FUNCTIONS: dict[str, tuple[int, Callable[..., Column]]] = {
    "pow": (2, power),
    "exp": (1, F.exp),
    "ln": (1, _log(F.log)),
    "log2": (1, _log(F.log2)),
    "log10": (1, _log(F.log10)),
    "min": (2, lambda a, b: F.when(_less(b, a), b).otherwise(a)),
    "max": (2, lambda a, b: F.when(_less(a, b), b).otherwise(a)),
    "pi": (0, lambda: _d(math.pi)),
    "e": (0, lambda: _d(math.e)),
    "sin": (1, F.sin),
    "cos": (1, F.cos),
}
#: Binding strength; all but the sign bind to the left.
_STRENGTH = {"+": 2, "-": 2, "*": 3, "/": 3, "sign": 4}
_BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": divide}


def lex(text: str) -> list[tuple[str, str]]:
    """(kind, text) tokens; kinds: number, name, and the characters + - * / ( ) , themselves."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c in " \t\r\n":
            at += 1
        elif c in "+-*/(),":
            out.append((c, c))
            at += 1
        elif c.isdigit() or c == ".":
            m = _NUMBER.match(text, at)
            end = m.end() if m else at
            if not m or (end < len(text) and (text[end].isalnum() or text[end] in "._")):
                raise EngineError("INVALID_NUMBER", text[at:])
            out.append(("number", m.group()))
            at = end
        elif m := _NAME.match(text, at):
            out.append(("name", m.group()))
            at = m.end()
        else:
            raise EngineError("INVALID_FORMULA_CHARACTER", c)
    return out


class _Reader:
    def __init__(self, variable: Callable[[str], Column]):
        self.variable, self.values, self.waiting, self.names = variable, [], [], []

    def read(self, text: str) -> Column:
        tokens = lex(text)
        operand = True  # whether an operand may come next
        closed = False  # whether a number or a closing parenthesis came last, after which no operand may
        for n, (kind, word) in enumerate(tokens):
            if closed and kind in ("number", "name", "("):
                raise EngineError("UNEXPECTED_TOKEN", word)
            if kind == "number":
                self.values.append(_d(float(word)))
                operand, closed = False, True
            elif kind == "name":
                if n + 1 < len(tokens) and tokens[n + 1][0] == "(":
                    if word not in FUNCTIONS:
                        raise EngineError("UNEXPECTED_TOKEN", f"no function {word}")
                    self.waiting.append(("call", word))
                    operand, closed = True, False
                    continue
                if word not in self.names:
                    self.names.append(word)
                self.values.append(self.variable(word))
                # a name may be followed by another one; the value left over is reported at the end
                operand, closed = False, False
            elif kind == "(":
                self.waiting.append(("(", word))
                operand = True
            elif kind == ")":
                self._until_open(MISSING=True)
                self.waiting.pop()
                if self.waiting and self.waiting[-1][0] == "call":
                    self._apply(self.waiting.pop())
                operand, closed = False, True
            elif kind == ",":
                self._until_open(MISSING=False)
                operand, closed = True, False
            elif operand and kind in "+-":
                if kind == "-":
                    self.waiting.append(("sign", "sign"))
            else:
                while self.waiting and self.waiting[-1][0] in ("op", "sign") and _STRENGTH[self.waiting[-1][1]] >= _STRENGTH[kind]:
                    self._apply(self.waiting.pop())
                self.waiting.append(("op", kind))
                operand, closed = True, False
        while self.waiting:
            top = self.waiting.pop()
            if top[0] == "(":
                raise EngineError("MISSING_PAREN")
            self._apply(top)
        if len(self.values) != 1:
            raise EngineError("SHUNT_EXTRA_EXPRESSIONS" if len(self.values) != 0 or not tokens else "SHUNT_MISSING_OP_ARG")
        return self.values[0]

    def _until_open(self, MISSING: bool) -> None:
        while self.waiting and self.waiting[-1][0] != "(":
            self._apply(self.waiting.pop())
        if MISSING and not self.waiting:
            raise EngineError("MISSING_PAREN")

    def _apply(self, what: tuple[str, str]) -> None:
        kind, name = what
        if kind == "call":
            count, fn = FUNCTIONS[name]
            missing = "SHUNT_MISSING_FUNC_ARG"
        else:
            count, fn = (1, lambda a: -a) if kind == "sign" else (2, _BINARY[name])
            missing = "SHUNT_MISSING_OP_ARG"
        if len(self.values) < count:
            raise EngineError(missing, name)
        args = self.values[len(self.values) - count :]
        del self.values[len(self.values) - count :]
        self.values.append(fn(*args))


@dataclass(frozen=True)
class Formula:
    """A compiled formula: its value, NULL where any field it names is NULL, and these fields."""

    text: str
    value: Column
    fields: list[str]


def compile_formula(text: str, schema=None) -> Formula:
    """Names must be fields of `schema` where one is given."""
    kinds = schema.kinds if schema else {}
    double = lambda n: F.col(f"`{n}`").cast("int").cast("double") if kinds.get(n) == "bool" else F.col(f"`{n}`").cast("double")
    reader = _Reader(double)
    value = reader.read(text)
    if schema:
        schema.resolve(reader.names)
    known = F.lit(True)
    for n in reader.names:
        known = known & F.col(f"`{n}`").isNotNull()
    return Formula(text, F.when(known, value) if reader.names else value, reader.names)
