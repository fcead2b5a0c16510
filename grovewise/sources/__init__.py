"""Files: binary point clouds as Spark data sources, stem maps, manifests and sidecars.

Point files are read and written by tasks through ordinary paths, so on a cluster they lie on a file system that all executors mount.
"""
