"""Building blocks over any DataFrame: compaction, islands, overlays, joins in time, copies, rules."""
