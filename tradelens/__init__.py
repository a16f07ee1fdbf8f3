"""tradelens: disclosure-signal analytics as Spark DataFrame operators."""
