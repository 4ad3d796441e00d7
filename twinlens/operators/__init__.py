"""Two-sample operators: functions from DataFrame to DataFrame."""
