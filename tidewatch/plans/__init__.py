"""Whole jobs built of the operators, and the registered queries."""
