"""pulsegrid: rhythm and event-timeline analytics on Spark DataFrames."""
