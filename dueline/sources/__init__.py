"""Readers and writers for event logs and result tables."""
