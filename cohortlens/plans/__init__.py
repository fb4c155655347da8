"""Registered queries, by section of the survey."""

from importlib import import_module

from .registry import REGISTRY

SECTIONS = ("source_plans", "clean_plans", "join_plans", "profile_plans", "window_plans", "ranking_plans", "inference_plans", "monitor_plans",
            "feature_plans", "model_plans", "path_plans", "mixed_plans", "grouped_plans", "pair_plans", "class_plans")


def load() -> dict:
    """Import every section and return the registry."""
    for section in SECTIONS:
        import_module(f"{__name__}.{section}")
    return REGISTRY
