"""Peer benchmarking and segmentation of people tables on Spark DataFrames."""

from peerbench.config import Settings

__all__ = ["Settings"]
