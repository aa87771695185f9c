"""File tables, ignore rules, snapshots and the per-format extraction jobs."""
