"""Reading and writing tables, versions and snapshots."""
