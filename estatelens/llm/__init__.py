"""Operators for preparing training data: texts, vectors, web pages and token files.

Nothing else in the library imports this folder. Each module is one operator; ``queries`` registers
them over the given tables.
"""
