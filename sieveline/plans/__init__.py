"""Helpers that shape plans: lineage cuts, checked broadcasts, salting."""
