"""Queries over the star schema that exercise every operator."""


def load():
    """The registry, with all modules that add to it imported."""
    from . import more_queries, queries, registry  # noqa: F401

    return registry
