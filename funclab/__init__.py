"""Spark operators for labelled function tables: cleaning, experiments, prompts, answers and scores."""
