"""From a star schema to the complete set of reports."""
