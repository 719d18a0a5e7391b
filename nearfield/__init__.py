"""nearfield: nearest-neighbour retrieval over embedding tables, on Spark."""

from nearfield.session import attach

__all__ = ["attach"]
__version__ = "0.1.0"
