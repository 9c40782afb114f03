"""Readers, writers and parameterised SQL extracts."""
