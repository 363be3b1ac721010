"""Expressions that operators are built of."""
