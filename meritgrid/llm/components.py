"""What the corpus operators take from the engine: components of graphs, and work kept in the shared folder."""

from __future__ import annotations

from meritgrid.functions.graph import components, contracted, forest
from meritgrid.functions.positions import settled as cut
from meritgrid.functions.positions import shared_folder

__all__ = ["components", "contracted", "cut", "forest", "shared_folder"]
