"""Written intermediate tables: the library's own."""

from __future__ import annotations

from strandflow.store import drop, shared_dir, written

__all__ = ["drop", "shared_dir", "written"]
