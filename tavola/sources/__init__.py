"""Sources and sinks: raw item files, intermediate tables, reports, models,
feature metadata and the prediction log."""
