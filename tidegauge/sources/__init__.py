"""Readers with declared schemas; a missing path reads as an empty table."""
