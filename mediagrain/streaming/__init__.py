"""Operators over event streams; each works on a static table too (its batch twin)."""
