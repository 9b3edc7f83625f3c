"""Readers, writers and the tables that queries are run on."""
