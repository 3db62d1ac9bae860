"""Where relations go: tables, partitions and files."""
