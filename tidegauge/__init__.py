"""A time-series analytics engine planned entirely as Spark DataFrame operations."""

from importlib import import_module

_HOMES = {"Engine": "engine", "Limits": "engine", "QueryError": "plans.literals", "register_function": "functions.registry"}
__all__ = list(_HOMES)


def __getattr__(name: str) -> object:
    """Loaded on first use: Python workers on executors import the package alone."""
    if name not in _HOMES:
        raise AttributeError(name)
    return getattr(import_module(f".{_HOMES[name]}", __name__), name)
