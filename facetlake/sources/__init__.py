"""Readers of annotation, mesh, manifest and log files, and writers of results."""
