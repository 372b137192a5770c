"""Log-alert analytics on Spark: lines to events, events to alert batches, batches to reports."""
