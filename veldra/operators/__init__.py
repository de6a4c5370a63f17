"""Statements as DataFrame plans."""
