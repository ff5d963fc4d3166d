"""Analytics of conversation transcripts and other token-level, time-stamped language data on Spark."""
