"""Registered queries with their SQL, and composite plans."""
