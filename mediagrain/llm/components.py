"""The library's shared folders, spread joins and components, by the names the corpus operators use."""

from mediagrain.operators.components import components, new_folder, removed, sent, shared_folder, spread_join, written

__all__ = ["components", "new_folder", "removed", "sent", "shared_folder", "spread_join", "written"]
