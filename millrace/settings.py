"""Size bounds used by the library.

Each bound guards a step that would otherwise gather data in one place.  Beyond
the bound the code takes another exact way, or raises; it never drops rows.
"""

# Largest number of rows of one group that a single task may order or buffer.
MAX_GROUP_ROWS = 2_000_000

# Largest number of values whose exact percentile may be kept in one aggregation buffer.
MAX_PERCENTILE_ROWS = 1_000_000

# Largest number of values gathered to finish a distributed quantile search.
MAX_BRACKET_VALUES = 100_000

# Largest number of fitted entries that become a literal lookup inside the plan.
MAX_LITERAL_ENTRIES = 2_000

# Largest measured size of a table that may be sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024

# Largest number of rows that a task of an iterative model fit holds.
FIT_TASK_ROWS = 500_000

# Pairs of nodes that a task makes distinct.
PAIR_TASK_ROWS = 1_000_000

# Rows per block of the nearest-neighbour join, reference points drawn per cell, and bytes of all of them in a task;
# bytes of the donors that a task of the join holds.
NEIGHBOR_BLOCK_ROWS = 4_096
NEIGHBOR_FAN = 32
NEIGHBOR_TREE_BYTES = 32 * 1024 * 1024
NEIGHBOR_POOL_BYTES = 16 * 1024 * 1024
