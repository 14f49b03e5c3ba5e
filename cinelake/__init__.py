"""Analytics over media timelines, processing jobs and their events, as Spark DataFrames."""
