"""Named queries over the test tables, with their SQL where SQL can say the same."""

from . import merging, scalars, searching, storage, storing

_ALL = {**scalars.QUERIES, **merging.QUERIES, **searching.QUERIES, **storing.QUERIES, **storage.QUERIES}


def queries() -> dict:
    return {name: q for name, (q, _) in _ALL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
