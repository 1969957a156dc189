"""Progress logs as streams."""
