"""tideline: rolling-origin forecast evaluation and data preparation on Spark."""
