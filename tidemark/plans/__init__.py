"""Registered queries: derived inputs, the plans over them, and their SQL."""
