"""Compositions of operators, and how the test tables stand in for a corpus."""
