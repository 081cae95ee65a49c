"""Named queries over the standard tables, each with its SQL."""
