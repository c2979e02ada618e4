"""Assembles one SQL statement from a body and the named common table expressions it mentions."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
_NAME = re.compile(r"\bx_\w+")


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def build(body: str) -> str:
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in dict.fromkeys(_NAME.findall(sql)):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in ordered)
    return f"WITH {parts}\n{body.strip()}"


def re2(pattern: str) -> str:
    """A pattern of ``fixed_values`` for RE2: without the flags it lacks, a look-ahead for one sign as a sign or the end."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if flags:
        kept = "".join(f for f in flags[1] if f not in "Ud")
        pattern = (f"(?{kept})" if kept else "") + pattern[flags.end() :]
    return pattern.replace("(?!>)", "(?:[^>]|$)").replace("'", "''")


def h(expr: str) -> str:
    """First 8 hex digits of md5 as BIGINT."""
    return f"(('0x' || substr(md5({expr}), 1, 8))::BIGINT)"


def r6(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 6) + 0.0::DOUBLE)"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"
