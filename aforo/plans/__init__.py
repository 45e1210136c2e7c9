"""Whole jobs: scan, compute, store, report."""
