"""Related-table search over a data lake, and operators for training-data pipelines, as Spark plans."""
