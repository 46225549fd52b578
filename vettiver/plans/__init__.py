"""The registered queries over the project's tables, and the same results as SQL."""
