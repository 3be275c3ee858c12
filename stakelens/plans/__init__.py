"""Registered queries, one module per family."""

from importlib import import_module

FAMILIES = ("gate", "scalars", "sweeps", "validation", "grading", "form", "correlation", "ingest", "streams", "models", "market_models", "reports")


def load_all() -> None:
    for family in FAMILIES:
        import_module(f"stakelens.plans.{family}")
