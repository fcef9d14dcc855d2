"""The same bindings and queries in plain SQL, for the DuckDB cross-check.

Each entry of ``ORACLE`` is a complete statement over the driver's pre-registered
views (documents, conversations, events, lineitem, pages, ...). Column names and types
match the Spark results: integers are BIGINT, sizes DECIMAL(12,2), lists are joined
to text.
"""

from __future__ import annotations


def half_even_div(num: str, den: int) -> str:
    """SQL for round-half-even(num / den), exact in integers (num >= 0)."""
    q = f"(({num}) // {den})"
    r = f"(({num}) % {den})"
    return f"({q} + CASE WHEN 2 * {r} > {den} OR (2 * {r} = {den} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"


def size_bucket(col: str) -> str:
    return f"CAST({half_even_div(f'CAST({col} AS BIGINT) * 100', 1048576)} / 100.0 AS DECIMAL(12,2))"


VIEWS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str, *views: str) -> None:
    """Register ``sql`` with the views it needs (dependencies first)."""
    needed: list[str] = []

    def add(v: str) -> None:
        for dep in DEPS.get(v, ()):
            add(dep)
        if v not in needed:
            needed.append(v)

    for v in views:
        add(v)
    if needed:
        ctes = ",\n".join(f"{v} AS (\n{VIEWS[v]}\n)" for v in needed)
        body = sql.lstrip()
        if body[:5].upper() == "WITH ":
            sql = f"WITH {ctes},\n{body[5:]}"
        else:
            sql = f"WITH {ctes}\n{sql}"
    ORACLE[name] = sql


DEPS: dict[str, tuple[str, ...]] = {}


def view(name: str, sql: str, *deps: str) -> None:
    VIEWS[name] = sql
    DEPS[name] = deps


def load_all() -> dict[str, str]:
    # Dependency order: later modules use views of earlier ones.
    from threadlake.plans import sql_index, sql_scalars, sql_threads, sql_integrity, sql_curation  # noqa: F401, I001
    return ORACLE

