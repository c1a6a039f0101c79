"""The periodic jobs as streams: ingest, rollups, de-duplication, alerts, actuals, checks."""
