"""Web-contact analytics on Spark: page stores, site lists and company names to contact tables."""
