"""Knowledge-base curation on Spark: dump parsing, class closures, imprecise-date
reconciliation, ranking, review queues, change sets and coverage statistics."""
