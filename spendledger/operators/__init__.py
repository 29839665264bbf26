"""Ledger operators, each ``DataFrame -> DataFrame``."""
