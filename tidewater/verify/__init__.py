"""Correctness oracle (independent DuckDB SQL) and the comparison helper."""
