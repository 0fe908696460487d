"""Sources and sinks: photo tables, image files, reports, models."""
