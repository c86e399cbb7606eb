"""Pure DataFrame -> DataFrame transforms, the same for tables and streams."""
