"""Reconciling two inventories of the same stock on Spark, and preparing training data.

``functions``: column expressions; ``operators``: DataFrame to DataFrame; ``sources``:
workbooks and reports; ``plans``: the whole comparison; ``streaming``: claims as a stream.
"""
