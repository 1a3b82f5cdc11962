"""Named queries over the test tables."""


def all_queries():
    """``(queries, oracles)`` of every registered query."""
    import importlib

    from ostinato.plans import registry

    for module in ("tables", "catalog", "tags", "similarity", "semantic", "evaluate", "interactions", "streams", "jobs"):
        importlib.import_module(f"ostinato.plans.queries_{module}")
    return registry.QUERIES, registry.ORACLES
