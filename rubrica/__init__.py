"""Grading analytics on Spark: answers, rubrics, marks and class reports as DataFrame jobs."""
