"""Survival analysis and voxel-texture operators over Spark DataFrames."""

__version__ = "0.1.0"
