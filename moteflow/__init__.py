"""moteflow: single-particle localization and tracking analysis as Spark DataFrame operators."""
