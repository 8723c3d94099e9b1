"""Relational and learning operators: ``DataFrame -> DataFrame``."""
