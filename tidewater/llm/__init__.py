"""Operators for large-scale training-data pipelines.

Self-contained: nothing else in the library imports this package.  Each
module holds one operator with its general interface; ``queries`` registers
one query per operator and its DuckDB SQL where SQL can express it.
"""
