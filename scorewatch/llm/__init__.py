"""Operators for preparing language-model training data, with the registered queries
that apply them to the given tables. Nothing else in the library imports this subpackage."""
