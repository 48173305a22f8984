"""Column functions: extended time, modes and planar geometry."""
