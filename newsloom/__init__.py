"""Analytics for collections of short texts, on Spark."""

from newsloom.plans.ask import (
    category_remainder,
    category_stats,
    fulltext_search,
    sentiment_stats,
    significant_sizes,
    significant_words,
)
from newsloom.plans.refresh import RefreshOptions, RefreshSummary, refresh
from newsloom.plans.snapshot import restore_snapshot, take_snapshot
from newsloom.session import configured
from newsloom.sources.warehouse import Warehouse
from newsloom.streaming.refresh import follow_files, refresh_periodically

__all__ = [
    "RefreshOptions",
    "RefreshSummary",
    "Warehouse",
    "category_remainder",
    "category_stats",
    "configured",
    "follow_files",
    "fulltext_search",
    "refresh",
    "refresh_periodically",
    "restore_snapshot",
    "sentiment_stats",
    "significant_sizes",
    "significant_words",
    "take_snapshot",
]
