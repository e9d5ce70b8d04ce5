"""The incremental forms of compaction, windows, sessions and throttling."""
