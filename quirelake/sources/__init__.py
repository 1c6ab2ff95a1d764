"""Readers of bibliographies and books."""
