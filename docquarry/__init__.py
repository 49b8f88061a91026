"""Document analytics on Spark: collections, filters, pipelines, changelogs, structures, messages, monitoring."""
