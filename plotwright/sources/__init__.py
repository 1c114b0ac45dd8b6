"""Scans of grid, map and feature files, and the sinks that write them."""
