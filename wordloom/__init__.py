"""Word timelines, stitching and text preparation on PySpark DataFrames."""
