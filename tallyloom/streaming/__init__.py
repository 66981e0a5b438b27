"""Structured Streaming forms of the algebraic operators."""
