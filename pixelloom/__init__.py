"""Image-relation analytics and corpus operators on Spark DataFrames."""
