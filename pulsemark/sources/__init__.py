"""Readers, writers, incremental load and file audits."""
