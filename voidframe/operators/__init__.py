"""Operators over atoms, voxels, octree nodes and pore nodes; every table carries structure_id."""
