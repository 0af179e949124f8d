"""Operators of a training-data pipeline (text, chat, web archive) on Spark DataFrames."""
