"""Registered queries and the SQL each is compared with."""

from importlib import import_module

MODULES = ("court", "governance", "audits", "jobs")


def load_all():
    """``(queries, sql)`` of all modules."""
    for module in MODULES:
        import_module(f"checks.{module}")
    from checks.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
