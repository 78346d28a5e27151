"""One SQL text for Spark and for the engine it is checked with.

Texts use ``//`` for integer division, ``RINT(x)`` for rounding half to even, ``RANGE(a, b) t`` for a table of
i, and double literals with an exponent (1e0), which both engines read as doubles."""

from __future__ import annotations

import re


def _call(sql: str, name: str, form) -> str:
    out, at = "", 0
    for m in re.finditer(rf"\b{name}\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at : m.start()] + form(_call(sql[m.end() : end - 1], name, form))
        at = end
    return out + sql[at:]


def _top_level(args: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(args):
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(args[at:i])
            at = i + 1
    return [*parts, args[at:]]


def spark(sql: str) -> str:
    sql = _call(sql, "RANGE", lambda a: f"(SELECT CAST(id AS INT) AS i FROM range({a}))")
    sql = _call(sql, "UNNEST_RANGE", lambda a: "explode(sequence({0}, {1} - 1))".format(*_top_level(a)))
    return _call(sql, "RINT", lambda a: f"rint({a})").replace("//", " div ")


def duck(sql: str) -> str:
    sql = _call(sql, "RANGE", lambda a: f"(SELECT CAST(range AS INTEGER) AS i FROM range({a}))")
    sql = _call(sql, "UNNEST_RANGE", lambda a: "CAST(unnest(range({0}, {1})) AS INTEGER)".format(*_top_level(a)))
    return _call(sql, "RINT", lambda a: f"round_even({a}, 0)")
