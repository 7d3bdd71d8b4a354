"""Registry of named queries and helpers that shape physical plans."""
