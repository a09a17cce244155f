"""A media catalog and ingest engine on Spark: scans, identity, classification, planning, recovery, summaries, change
feeds, all as DataFrame functions."""
