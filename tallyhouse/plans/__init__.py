"""Plan inspection helpers (physical plan checks used by tests and bench)."""
