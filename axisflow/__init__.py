"""Trajectory-operator analytics for ordered observations, as Spark DataFrame operators."""

__version__ = "0.1.0"
