"""Physical-plan building blocks: global ranks, bounded broadcasts, grids and quadtrees."""
