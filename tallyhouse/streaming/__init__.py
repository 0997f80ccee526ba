"""Incremental posting driven by a stream of invoice edits."""
