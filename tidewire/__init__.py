"""tidewire: news-intelligence analytics as Spark DataFrame operators."""
