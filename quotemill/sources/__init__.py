"""Extracts, payload mappers, ledger and publication sinks."""
