"""fundlens: fund analytics as DataFrame -> DataFrame operators on Spark."""
