"""Registered queries: every operator applied to the shared tables, with DuckDB SQL where SQL can say it."""
