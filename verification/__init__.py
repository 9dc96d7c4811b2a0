"""Registered queries and the DuckDB SQL each is checked against."""
