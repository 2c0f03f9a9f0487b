"""Named queries over the given tables, each with its SQL twin where SQL can express it."""

from importlib import import_module

SECTIONS = ["cleaning", "joins", "aggregates", "windows", "tables", "scalars", "sources", "stateful", "training"]


def load():
    """(queries, SQL twins) of every section."""
    from hourlake.catalog import registry

    for s in SECTIONS:
        import_module(f"hourlake.catalog.{s}")
    return registry.QUERIES, registry.ORACLES
