"""voxquarry: voxel-world storage, validation and analytics as Spark DataFrames."""
