"""Readers and writers for sample tables, polygon layers, rasters and checkpoints."""
