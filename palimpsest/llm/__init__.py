"""Operators for corpus building; nothing outside this subpackage imports it."""
