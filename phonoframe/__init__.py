"""Speech-feature analytics on Spark: utterances, frames and aligned labels as DataFrames."""
