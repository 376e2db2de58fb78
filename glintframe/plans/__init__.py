"""Registered queries over the reference's operators, and their SQL, by module."""

from __future__ import annotations

from glintframe.plans import embeddings, evaluation, history, kernels, manifest, models, narrative, planes, sources
from glintframe.plans.registry import Query

MODULES = (manifest, kernels, evaluation, history, embeddings, narrative, sources, models, planes)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.reg.queries.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.reg.oracles.items()}
