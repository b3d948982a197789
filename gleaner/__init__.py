"""gleaner: digest analytics on Spark."""
