"""Spark-native analytics over revision-tracked documents."""

__version__ = "0.1.0"
