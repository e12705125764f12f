"""Spark jobs for score histories of timed ranking contests."""
