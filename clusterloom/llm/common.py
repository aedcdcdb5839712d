"""Helpers shared by the training-data operators."""

from clusterloom.functions.scratch import cut, release, scratch_path, shared_dir, table

__all__ = ["cut", "release", "scratch_path", "shared_dir", "table"]
