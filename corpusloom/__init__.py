"""A web-corpus engine on Spark: crawl logic, text documents, datasets."""
