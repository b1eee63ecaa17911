"""Whole plans put together from operators, and the catalogue of registered queries."""
