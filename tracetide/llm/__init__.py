"""Operators for building training corpora from text tables, and their registered queries."""
