"""Spark-native analytics over ordered combat-event logs."""

from fraylens.options import Options

__all__ = ["Options"]
