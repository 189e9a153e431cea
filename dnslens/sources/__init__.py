"""Readers: field lines, envelopes, captures, sessions and scan replies."""
