"""veridra: lineage, data quality, schema drift and SQL review on Spark."""
