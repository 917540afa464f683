"""Operators for preparing training data, with their queries. Nothing outside this folder imports it."""
