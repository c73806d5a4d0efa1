"""Training-data operators on Spark: URL filters, exact dedup, source mixing,
n-gram Jaccard join, token packing, PII surrogates, chat formatting, toxicity
scoring, BPE encoding and quality rules. Nothing else in the library imports
this subpackage."""
