"""Schemas, tables, logs and adapters: where rows come from and go to."""
