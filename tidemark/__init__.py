"""Spark-native batch pipeline: Bronze history to a star schema.

Every operator is a function from DataFrame to DataFrame.  Nothing runs until
a sink in ``tidemark.sources`` or ``tidemark.plans.stages`` asks for it.
"""
