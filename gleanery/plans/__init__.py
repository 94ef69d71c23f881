"""Named queries over the tables, and SQL with the same rows."""
