"""Build, grade and evaluate model-routing datasets with Spark DataFrames."""
