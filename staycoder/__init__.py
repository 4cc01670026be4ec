"""Clinical-note coding on Spark: clean, measure, window, embed, classify and score notes as DataFrames."""
