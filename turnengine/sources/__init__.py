"""Readers. Every reader gives an explicit order column, and empty strings where the files have nothing."""
