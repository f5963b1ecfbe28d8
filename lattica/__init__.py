"""Lattica: joint analysis of observation-by-feature count matrices on Spark."""
