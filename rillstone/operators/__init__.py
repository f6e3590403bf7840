"""Graph, placement, lifecycle, movement and history operators."""
