"""Whole comparisons, from two sheets to a report."""
