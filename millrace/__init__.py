"""millrace: machine-condition analytics and corpus preparation on Spark DataFrames."""
