"""Reading and writing: folders of source files, outbox tables, ranked lists, snapshots."""
