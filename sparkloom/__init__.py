"""Text data for language models, as Spark DataFrame operators."""
