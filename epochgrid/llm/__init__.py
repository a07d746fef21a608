"""Operators for the texts and names of a training corpus. Nothing else in the library imports this package."""
