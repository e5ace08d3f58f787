"""Whole jobs, each a composition of sources, operators and functions."""
