"""auditweave: code-audit analytics over source corpora, expressed as Spark DataFrames."""
