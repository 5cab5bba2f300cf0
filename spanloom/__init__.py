"""spanloom: trace linking, field lineage, scoring and cost analysis as Spark DataFrame jobs."""
