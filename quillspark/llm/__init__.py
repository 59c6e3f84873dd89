"""Training-data operators: tokenisers, filters, scans and near-duplicate joins.

Nothing outside this subpackage imports it; ``queries.py`` holds its registered
queries and their SQL.
"""
