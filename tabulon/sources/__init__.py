"""Readers, workspaces and sinks."""
