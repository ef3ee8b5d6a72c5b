"""Whole queries: tables in, result frames out."""
