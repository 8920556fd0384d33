"""Panel analytics on Spark: long-form date x symbol panels, operators as column expressions."""
