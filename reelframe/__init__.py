"""Media-catalogue and playback analytics as Spark jobs."""
