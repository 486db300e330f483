"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from lumora.schema import EPISODES_SQL


class Registry:
    """The queries of one module, each beside the SQL that has to give the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, episodes: bool = False):
        def add(query):
            self.queries[query.__name__] = query
            if sql is not None:
                text = sql.replace("__EP__", EPISODES_SQL)
                start = "WITH " + EPISODES_SQL + (", " if text.lstrip().startswith("AND ") else " ")
                self.oracles[query.__name__] = (start + text.lstrip().removeprefix("AND ")) if episodes else text
            return query

        return add
