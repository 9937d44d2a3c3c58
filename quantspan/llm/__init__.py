"""Operators over documents and pages for preparing training data."""
