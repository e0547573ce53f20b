"""Registered queries over the test tables, each with its SQL."""


def load() -> None:
    """Import every module that registers queries."""
    from cofferlake.plans import cellar, imports, portfolio, stored, streams  # noqa: F401
