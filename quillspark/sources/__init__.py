"""Readers: vaults of Markdown pages, logs and blame, lexicons, and snapshot tables of outside services."""
