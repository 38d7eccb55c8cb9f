"""Registry of named queries and the SQL each one is checked against."""

from ..session import ship_package
from .views import Tables

QUERIES = {}
ORACLES = {}


def query(name, oracle=None):
    """Register `fn(tables) -> DataFrame` under `name`, with its DuckDB text when there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query name: {name}")

        def run(spark, folder):
            return fn(Tables(ship_package(spark), folder))

        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
