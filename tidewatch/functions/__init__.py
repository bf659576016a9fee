"""Column builders: parsing, predicates, addresses, scalar functions."""
