"""Spark-native analytics for conversations: intervals, transcripts, speakers, text guards."""
