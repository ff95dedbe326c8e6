"""Registered queries: operators applied to the given tables, each with its SQL check."""

from gridspark.plans.registry import ORACLE, QUERIES


def load() -> tuple[dict, dict]:
    """All queries and their SQL, by name."""
    from gridspark.plans import (  # noqa: F401
        climate, evaluation, modelling, profiling, reshaping, sampling, storage, streams,
    )
    return QUERIES, ORACLE
