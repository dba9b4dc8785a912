"""Named queries over the tables, with SQL for the same rows."""
