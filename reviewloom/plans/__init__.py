"""Operators composed into whole pipelines, and the registered queries."""
