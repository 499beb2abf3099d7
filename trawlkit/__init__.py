"""trawlkit: crawl-data analytics as PySpark DataFrame operators."""
