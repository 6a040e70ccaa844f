"""tidemark: a PySpark-native engine for keyed, versioned data.

An append-only changelog of puts and deletes is the source of truth; every
answer (lookup, scan, merge, compaction, replica read, metric) is a DataFrame
plan over it.
"""

__version__ = "0.1.0"
