"""Column functions over texts, titles, identifiers and scores."""
