"""Named queries: each module registers a section of them."""

from importlib import import_module, util

SECTIONS = (
    "filters", "joins", "aggregates", "windows", "sorts", "scalars", "merges", "dataquality", "alerting", "daily",
    "gates", "pagejobs", "streams", "inputs",
)


def load_all() -> None:
    for section in SECTIONS:
        if util.find_spec(f"rentscope.plans.{section}") is not None:
            import_module(f"rentscope.plans.{section}")
