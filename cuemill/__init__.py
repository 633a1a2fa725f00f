"""Spark-first operators for transcript, cue and media-catalogue data."""
