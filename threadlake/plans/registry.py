"""All registered queries with their DuckDB oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from threadlake.sources.lens import Lens, with_lens

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
#: Queries that SQL cannot express.
ROWS_ONLY: set[str] = set()


def query(name: str, sql: str | None = None, lens: str = ""):
    """Registers a function of a lens as a query; ``lens`` names the projections its oracle starts from."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Lens(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_lens(sql, *lens.split()) if lens else sql
        return f

    return register


from threadlake.plans import formats, identity, imports, ingest, reading, values  # noqa: E402, F401  (they register their queries)
