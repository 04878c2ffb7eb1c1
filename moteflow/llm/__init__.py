"""Operators for preparing training text: one module for each, their queries in ``queries``."""
