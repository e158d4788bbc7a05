"""Relational and table-changing operators as DataFrame functions."""
