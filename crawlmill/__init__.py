"""crawlmill: a Spark-native engine for site-audit analytics and crawl-corpus preparation."""
