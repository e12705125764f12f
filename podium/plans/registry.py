"""Where queries and their SQL twins are put together."""

from __future__ import annotations

from podium.plans.adapters import sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, body: str | None = None, speed: bool = False, extra: str = ""):
    """Registers a function (spark, sf_dir) -> DataFrame, and the SQL over the adapters' tables that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if body:
            own = body.strip()
            if own.startswith("WITH "):  # its own tables come after the adapters'
                extra_, own = ", " + own[5:], ""
            else:
                extra_ = ""
            ORACLES[name] = sql(own, speed, extra + extra_)
        return f

    return add
