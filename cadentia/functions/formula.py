"""User formulas as columns: parsed on the driver, evaluated inside Catalyst."""

from __future__ import annotations

import json
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Built-in formulas.
BUILT_IN = {"classic": "(duration*IF^2)*100", "bikescore": "(duration*(IF^1.5))*100"}
_ALLOWED = re.compile(r"[A-Za-z0-9_()^*+/\-. ]+")
_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*|\.\d+)|([A-Za-z_][A-Za-z0-9_]*)|([()^*+/\-]))")


class FormulaError(ValueError):
    """A formula that can't be read."""


def validate(text: str) -> None:
    """Not empty, balanced parentheses, known characters only."""
    if not text.strip():
        raise FormulaError("empty formula")
    if not _ALLOWED.fullmatch(text):
        raise FormulaError("unknown character")
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            raise FormulaError("unbalanced parentheses")
    if depth:
        raise FormulaError("unbalanced parentheses")


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at]!r}")
        out.append(("number", m[1]) if m[1] else ("name", m[2]) if m[2] else ("sign", m[3]))
        at = m.end()
    return out


def variables(text: str) -> list[str]:
    """Names in a formula, functions too, in order of appearance."""
    return list(dict.fromkeys(value for kind, value in _tokens(text) if kind == "name"))


def column(text: str, values: dict[str, Column]) -> Column:
    """The formula over columns, in doubles; division by zero and other non-finite results give null."""
    validate(text)
    tokens, at = _tokens(text), 0

    def peek() -> str | None:
        return tokens[at][1] if at < len(tokens) and tokens[at][0] == "sign" else None

    def take() -> tuple[str, str]:
        nonlocal at
        if at >= len(tokens):
            raise FormulaError("formula ends early")
        at += 1
        return tokens[at - 1]

    def sum_() -> Column:
        out = product()
        while peek() in ("+", "-"):
            out = out + product() if take()[1] == "+" else out - product()
        return out

    def product() -> Column:
        out = unary()
        while peek() in ("*", "/"):
            out = out * unary() if take()[1] == "*" else F.try_divide(out, unary())
        return out

    def unary() -> Column:
        if peek() in ("+", "-"):
            return -unary() if take()[1] == "-" else unary()
        return power()

    def power() -> Column:
        base = atom()
        if peek() == "^":
            take()
            return F.pow(base, unary())
        return base

    def atom() -> Column:
        kind, value = take()
        if kind == "number":
            return F.lit(float(value))
        if kind == "name":
            if value in ("sqrt", "abs", "exp", "ln") and peek() == "(":
                inner = atom()
                return {"sqrt": F.sqrt, "abs": F.abs, "exp": F.exp, "ln": F.ln}[value](inner)
            if value not in values:
                raise FormulaError(f"unknown variable {value}")
            return values[value].cast("double")
        if value == "(":
            inner = sum_()
            if take()[1] != ")":
                raise FormulaError("expected )")
            return inner
        raise FormulaError(f"unexpected {value!r}")

    out = sum_()
    if at != len(tokens):
        raise FormulaError(f"unexpected {tokens[at][1]!r}")
    return F.when(F.isnan(out) | (F.abs(out) == float("inf")), F.lit(None)).otherwise(out)


def quoted(text: str) -> str:
    """A TOML string."""
    return json.dumps(text, ensure_ascii=False).replace("\x7f", "\\u007f")


@dataclass
class Registry:
    """Named custom formulas, validated as they come in."""

    formulas: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, text: str) -> None:
        validate(text)
        self.formulas[name] = text

    def remove(self, name: str) -> bool:
        return self.formulas.pop(name, None) is not None

    def get(self, name: str) -> str | None:
        return self.formulas.get(name, BUILT_IN.get(name))

    def names(self) -> list[str]:
        return sorted({*BUILT_IN, *self.formulas})

    def load(self, toml: str) -> None:
        for name, text in tomllib.loads(toml).get("formulas", {}).items():
            self.add(name, text)

    def dump(self) -> str:
        return "[formulas]\n" + "".join(f"{quoted(name)} = {quoted(text)}\n" for name, text in sorted(self.formulas.items()))


def ftp(method: str, power: Column) -> Column:
    """FTP from a test: 20 minutes at 95 %, 8 minutes at 98 %, an hour as it is; rounded half to even."""
    return F.bround(power * {"twenty_minute": 0.95, "eight_minute": 0.98, "hour": 1.0}[method], 0).cast("int")
