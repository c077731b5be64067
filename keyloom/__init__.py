"""Partition-and-order analytics on Spark: row numbering per key, its planning tables, delivery and data preparation."""

__version__ = "0.1.0"
