"""Sensor and weather time-series toolkit on PySpark."""
