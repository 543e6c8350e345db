"""Operators for preparing training data; nothing outside this subpackage imports it."""
