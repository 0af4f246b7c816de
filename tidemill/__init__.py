"""tidemill: hourly sensor-network series, forecasts and run-log analytics as Spark jobs."""
