"""Field catalogs, readers, loading onto a grid, reshaping of vendor tables, and sinks."""

from . import excel
from .catalog import Catalog, Field

__all__ = ["excel", "Catalog", "Field"]
