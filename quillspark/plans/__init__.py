"""Changes to pages as planned tables, renderers, and the explicit sinks that apply them."""
