"""Command text: one line to a call of the client."""

from __future__ import annotations

import re
import shlex

from pointmill.errors import EngineError
from pointmill.functions.timerange import TimeRange
from pointmill.plans.client import Client

_SUMMARY = {
    "CREATE DATABASE": "create_database", "CREATE MEASUREMENT": "create_measurement", "LIST DATABASES": "databases",
    "LIST MEASUREMENTS": "measurements", "LIST SERIES": "series", "LIST SCHEMA": "schema", "LIST ACTIVE SERIES": "active",
    "COUNT": "count", "SELECT": "select", "COMPUTE": "compute", "MEAN": "mean", "INTEGRATE": "integrate", "DELETE": "delete",
}
_OPERATORS = ("<", "<=", "==", ">=", ">")


class _Words:
    """The words of a command, read from left to right. Key words match in any case; time_ns and window_ns don't."""

    def __init__(self, words: list[str]):
        self.words, self.at = words, 0

    def peek(self, ahead: int = 0) -> str:
        return self.words[self.at + ahead] if self.at + ahead < len(self.words) else ""

    def take(self, what: str = "a word") -> str:
        if self.at >= len(self.words):
            raise EngineError("INVALID_COMMAND", f"missing {what}")
        self.at += 1
        return self.words[self.at - 1]

    def keyword(self, *words: str) -> bool:
        if [self.peek(i).upper() for i in range(len(words))] != list(words):
            return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.keyword(*words):
            raise EngineError("INVALID_COMMAND", f"expected {' '.join(words)}")

    def exact(self, word: str) -> None:
        if self.take(word) != word:
            raise EngineError("INVALID_COMMAND", f"expected {word}")

    def number(self) -> int:
        word = self.take("a number")
        if not re.fullmatch(r"\d+", word):
            raise EngineError("INVALID_COMMAND", f"{word!r} is not a number")
        return int(word)

    def path(self, parts: int) -> list[str]:
        word = self.take("a path")
        out = word.split("/")
        if len(out) != parts or not all(out):
            raise EngineError("INVALID_COMMAND", f"{word!r} is not a path of {parts}")
        return out

    def time(self, required: bool = False, operators: tuple[str, ...] = _OPERATORS) -> TimeRange:
        """[WHERE time_ns op T | WHERE T0 op time_ns op T1]"""
        if not self.keyword("WHERE"):
            if required:
                raise EngineError("INVALID_COMMAND", "expected WHERE")
            return TimeRange()
        if self.peek() == "time_ns":
            self.at += 1
            op = self.take("an operator")
            if op not in operators:
                raise EngineError("INVALID_COMMAND", f"operator {op!r}")
            return TimeRange.compared(op, self.number())
        t0, low = self.number(), self.take("an operator")
        self.exact("time_ns")
        return TimeRange.framed(t0, low, self.take("an operator"), self.number())

    def limit(self) -> tuple[int | None, int | None]:
        if self.keyword("LIMIT"):
            return self.number(), None
        return (None, self.number()) if self.keyword("LAST") else (None, None)

    def window(self) -> int:
        self.exact("window_ns")
        return self.number()

    def end(self) -> None:
        if self.at < len(self.words):
            raise EngineError("INVALID_COMMAND", f"extra arguments {' '.join(self.words[self.at:])!r}")


def run(client: Client, text: str):
    """Result of a command: a frame, a list of names, or None. Errors come before any data is read."""
    try:
        w = _Words(shlex.split(text, posix=True))
    except ValueError as e:
        raise EngineError("INVALID_COMMAND", str(e)) from e
    for words, name in sorted(_SUMMARY.items(), key=lambda x: -len(x[0])):
        if w.keyword(*words.split()):
            break
    else:
        raise EngineError("INVALID_COMMAND", text)

    if name == "create_database":
        db = w.take("a name")
        w.end()
        return client.create_database(db)
    if name == "create_measurement":
        path = w.path(2)
        w.need("WITH", "FIELDS")
        fields = w.take("fields")
        w.end()
        return client.create_measurement(*path, fields)
    if name == "databases":
        w.end()
        return client.list_databases()
    if name == "measurements":
        w.keyword("FROM")
        db = w.take("a database")
        w.end()
        return client.list_measurements(db)
    if name in ("series", "schema"):
        w.keyword("FROM")
        path = w.path(2)
        w.end()
        return client.list_series(*path) if name == "series" else client.get_schema(*path)
    if name == "active":
        w.need("FROM")
        path = w.path(2)
        r = w.time(required=True)
        w.end()
        return client.list_active_series(*path, r.t0, r.t1)
    if name == "delete":
        w.need("FROM")
        path = w.path(3)
        r = w.time(required=True, operators=("<", "<="))
        w.end()
        return client.delete_points(*path, r.t1)
    if name == "count":
        w.need("FROM")
        path = w.path(3)
        r = w.time()
        w.end()
        return client.count_points(*path, r.t0, r.t1)

    fields: list[str] = []
    if not w.keyword("FROM"):
        fields = [w.take("a formula")] if name == "compute" else w.take("fields").split(",")
        w.need("FROM")
    elif name != "select":
        raise EngineError("INVALID_COMMAND", "missing fields")
    path = w.path(3)
    r = w.time()
    if name == "select":
        first, last = w.limit()
        w.end()
        if last is not None:
            return client.select_last_points(*path, fields, r.t0, r.t1, last)
        return client.select_points(*path, fields, r.t0, r.t1, first)
    if name == "compute":
        first, last = w.limit()
        w.end()
        if last is not None:
            return client.compute_last_points(*path, fields[0], r.t0, r.t1, last)
        return client.compute_points(*path, fields[0], r.t0, r.t1, first)
    if name == "mean":
        window = w.window()
        w.end()
        names = client.store.schema(*path[:2]).resolve(fields)
        return client.sum_points(*path, fields, r.t0, r.t1, window).select("window_ns", *[f"`{n}_mean`" for n in names])
    w.end()
    return client.integrate_points(*path, fields, r.t0, r.t1)
