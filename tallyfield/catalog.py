"""All queries of the library outside its optional subpackages."""

from __future__ import annotations

from .plans import evaluation, extensions, feeds, inventory, modelling, relational, training_data
from .registry import Registry

PLANS = (relational, evaluation, extensions, feeds, inventory, modelling, training_data)


def core_registry() -> Registry:
    registry = Registry()
    for module in PLANS:
        registry.merge(module.registry)
    return registry
