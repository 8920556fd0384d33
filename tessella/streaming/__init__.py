"""Panel cells from a stream of events, in late-tolerant event-time windows."""

from .cells import daily_cells, read_events

__all__ = ["daily_cells", "read_events"]
