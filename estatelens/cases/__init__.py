"""Registered queries over the given tables, each with its SQL check where SQL can say it."""
