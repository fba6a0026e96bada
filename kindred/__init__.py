"""Kindred: find, judge and resolve sets of records that belong together, on Spark."""
