"""Importing this module registers every family of queries."""

from starloom.plans import aggregates, columns, evaluation, models, pipelines, relations, reports, selection, stamps, tables  # noqa: F401
