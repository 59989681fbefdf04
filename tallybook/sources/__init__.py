"""Reading and writing: typed tables, snapshots, JSON documents, scratch tables."""
