"""A Spark library for text corpora: extraction, retrieval, ranking, conversation memory and evaluation."""
