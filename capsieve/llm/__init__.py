"""Operators for preparing training text: each by one named method, none used by the rest of the package."""
