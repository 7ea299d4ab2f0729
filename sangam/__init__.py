"""A bilingual (SQL and Roman-Urdu) analytics engine on Spark."""
