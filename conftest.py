"""Puts the repository root on the path for the tests."""
