"""Named queries over the given tables, each with a SQL statement that checks it."""
