"""Named queries over the provided tables, and the SQL that states the expected results."""
