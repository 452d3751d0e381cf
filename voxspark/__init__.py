"""voxspark: sparse 8-bit volumes as Spark tables."""
