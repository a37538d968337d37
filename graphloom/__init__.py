"""A Spark-native engine for text, knowledge graphs and question answering."""
