"""Registered queries over the test tables, each with its SQL counterpart where there is one."""

from types import ModuleType


def load_all() -> ModuleType:
    """Import every module that registers queries and return the registry."""
    from . import (  # noqa: F401
        base_queries,
        dynamics_queries,
        geo_queries,
        model_queries,
        product_queries,
        registry,
        share_queries,
        study_queries,
    )

    return registry
