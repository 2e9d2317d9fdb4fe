"""Registered queries and the SQL each of them is checked with."""

from __future__ import annotations


class Checks:
    """Collects queries and their checking SQL under one name each."""

    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None):
        def register(fn):
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = fn
            if oracle:
                self.oracles[name] = oracle
            return fn

        return register


CHECKS = Checks()


def load() -> Checks:
    from . import applications, catalogue, columns, feeds, graph, matching, pages, profiles, scorers, streams  # noqa: F401

    return CHECKS
