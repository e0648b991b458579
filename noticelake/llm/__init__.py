"""Operators for large training-data pipelines; nothing else in the library imports this subpackage."""

from importlib import import_module

#: Modules that register queries, by operator number.
MODULES = ("simhash", "warc", "langid", "line_dedup", "ann", "decontaminate", "url_filter", "quality", "license_scan", "packing", "divergence", "minhash", "alignment")


def gather() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all operators."""
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f".{name}", __name__)
        queries |= module.QUERIES
        sql |= module.ORACLE_SQL
    return queries, sql
