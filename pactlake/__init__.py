"""Contract analytics over a corpus, expressed as Spark DataFrame transformations."""
