"""Typed scans and write-once sinks."""
