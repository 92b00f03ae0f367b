"""Registered queries, grouped by area."""

import importlib

AREAS = ("store_queries", "gate_queries", "distance_queries", "polymer_queries", "cycle_queries",
         "label_queries", "frame_queries", "export_queries", "model_queries", "ring_queries", "sampling_queries", "file_queries")


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
