"""quantspan: Spark DataFrame transforms for panels of dated prices and returns."""
