"""Registered queries, the views they read and their SQL twins."""
