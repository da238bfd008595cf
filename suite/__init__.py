"""Registered queries over the given tables, each with SQL that must agree."""
