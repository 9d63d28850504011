"""Queries over the star-schema tables: each applies operators and stands beside the SQL that gives the same rows."""
