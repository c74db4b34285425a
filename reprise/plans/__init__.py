"""Multi-step plans: lineage cuts and graph components."""
