"""sparkwire: news-signal and insight analytics as Spark DataFrame operators."""
