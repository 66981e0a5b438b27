"""Named queries over the driver's tables, with their reference SQL."""
