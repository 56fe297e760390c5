"""A Spark-native engine that turns a stream of news articles into corroborated deal events."""
