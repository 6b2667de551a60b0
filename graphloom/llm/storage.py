"""Lineage cuts and stage tables in the folder that all executors share."""

from graphloom.plans.storage import cut, drop_written, ensure_checkpoint_dir, written

__all__ = ["cut", "drop_written", "ensure_checkpoint_dir", "written"]
