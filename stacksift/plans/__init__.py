"""Whole jobs built from the operators, and their binding to the test tables."""
