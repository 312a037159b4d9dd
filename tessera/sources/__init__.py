"""Readers: strict YAML and JSON, JSONL and CSV tables, lexicons, tables, dataset directories."""
