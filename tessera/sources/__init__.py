"""Inputs: the memory-store projection of the analytics tables, file sources and sinks."""
