"""Operators over tables: formatting, chunks, checks, lookups."""
