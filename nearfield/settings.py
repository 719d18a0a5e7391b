"""Defaults of the retrieval workload and the size limits of the engine."""

from __future__ import annotations

# Defaults of the retrieval workload.
K = 100
OVERFETCH = 10
FULL_DIM = 1024
DIMENSIONS = [256, 512, 1024]
IVF_LISTS = 100
IVF_PROBES = 10
IVF_PROBES_CODES = 50
GRAPH_DEGREE = 32
GRAPH_SEARCH_WIDTH = 1500
GRAPH_SEARCH_WIDTH_MAX = 1000
RABITQ_LISTS = 1000
RABITQ_PROBES = 100
RABITQ_EPSILON = 1.9

# Spark configuration keys an operator reads from its session.
BROADCAST_LIMIT_KEY = "nearfield.maxBroadcastBytes"
BROADCAST_LIMIT_DEFAULT = 256 * 1024 * 1024
QUERY_CHUNK_KEY = "nearfield.queryChunkRows"
QUERY_CHUNK_DEFAULT = 8192

# Rows x queries scored at once inside a task; bounds the task's memory.
BLOCK_CELLS = 1 << 21
# One side of a graph-building cell, one group of a shuffle: rows it has at least
# where there are more, rows and bytes it has at most, and cells it shall leave.
CELL_ROWS = 4096
CELL_ROWS_MOST = 32768
CELL_BYTES = 1 << 25
CELLS_LEAST = 96
