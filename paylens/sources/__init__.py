"""Readers: driver tables, the transactions adapter, files, payloads, stream records."""
