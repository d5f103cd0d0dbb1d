"""Decision analytics on Spark: functions from DataFrame to DataFrame over requests, predictions and labels."""
