"""Sessions over a universe grid, panels as columns of one frame, portfolios, and expressions as JSON."""

from .session import Session

__all__ = ["Session"]
