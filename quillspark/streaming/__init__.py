"""Incremental runs: pages that changed, and hits not seen before."""
