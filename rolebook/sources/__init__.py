"""Landed payloads and tables in, posting / seen / tracker rows out; sinks."""
