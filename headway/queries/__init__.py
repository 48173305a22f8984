"""Named queries over the driver's star tables, and SQL that gives the same rows."""
