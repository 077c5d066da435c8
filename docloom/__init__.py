"""docloom: document analytics and corpus preparation on Spark DataFrames."""
