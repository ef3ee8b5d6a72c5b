"""terrier: analytics over the text of land deeds, written as Spark plans.

A terrier is a register of landed property. The package turns recognised text
of deeds into scored, searchable records with DataFrame expressions only.
"""
