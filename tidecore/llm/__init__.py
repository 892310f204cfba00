"""Operators for corpus pipelines; nothing else in the library imports this folder."""
