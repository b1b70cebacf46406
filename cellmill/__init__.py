"""Reduction of point tables onto regular grids, as Spark plans."""
