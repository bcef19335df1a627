"""Query definitions. Importing a module registers its queries in `catalog`."""
import importlib

MODULES = ["panel_plans", "series_plans", "shape_plans", "runs_plans", "metric_plans", "pool_plans", "peer_plans", "learn_plans", "stream_plans"]


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
