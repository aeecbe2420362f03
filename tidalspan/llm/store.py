"""Intermediate tables in the shared folder of the cluster."""

from tidalspan.shared import keep, new_folder, shared_folder

__all__ = ["keep", "new_folder", "shared_folder"]
