"""Text-corpus, tokenizer, scoring and run-log analytics as Spark DataFrame operators."""
