"""Spark-native spend ledger: heterogeneous extracts in, one auditable ledger out.

Every operator is ``DataFrame -> DataFrame``.  Mapping, rule and rate tables are
arguments, timestamps are arguments, and nothing is collected to the driver
except configuration whose size is checked.
"""

__version__ = "0.1.0"
