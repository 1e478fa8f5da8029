"""Readers and writers: model registries, side files, graph files, documentation."""
