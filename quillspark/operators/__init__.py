"""Relational, graph and text-mining operators; each takes DataFrames and returns one."""
