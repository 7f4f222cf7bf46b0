"""Spark jobs over large collections of replicated spatial point patterns."""
