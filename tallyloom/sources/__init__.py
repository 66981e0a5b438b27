"""File and table connectors."""
