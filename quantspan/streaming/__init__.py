"""Operators over files that arrive one after the other."""
