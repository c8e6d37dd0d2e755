"""Program-facts analytics on Spark: facts, call graphs, summaries, reviews and their evaluation."""
