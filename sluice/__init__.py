"""Line-oriented combining and cleaning of data, expressed as Spark DataFrames."""
