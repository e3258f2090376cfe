"""Readers and writers for reports, tables, features and fitted artefacts."""
