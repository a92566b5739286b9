"""The library's queries over the parquet tables."""

from importlib import import_module

MODULES = ("text_queries", "date_queries", "rank_queries", "graph_queries", "hyper_queries", "segment_queries", "score_queries", "memory_queries", "prep_queries", "evidence_loop", "misc_queries", "loop_queries", "build_queries", "record_queries", "source_queries")


def load() -> None:
    """Import the modules, which register their queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
