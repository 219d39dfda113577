"""Readers and writers for task files, graphs, registries and reports."""
