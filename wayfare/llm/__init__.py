"""Training-data operators: PII, line and document near duplicates, mixing,
sharding, quality rules, decontamination, HTML extraction, URL filters and
substring dedup.  Nothing else in the library imports this subpackage."""
