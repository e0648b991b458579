"""Registered queries: each module has QUERIES (name -> function of spark, sf_dir) and ORACLE_SQL."""

from importlib import import_module

MODULES: tuple[str, ...] = ("search", "page_queries", "merge_queries", "routing_queries", "storage_queries", "stream_queries")


def gather(package: str, modules: tuple[str, ...]) -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in modules:
        module = import_module(f"{package}.{name}")
        queries |= module.QUERIES
        sql |= module.ORACLE_SQL
    return queries, sql
