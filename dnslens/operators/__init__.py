"""Operators (``DataFrame -> DataFrame``)."""
