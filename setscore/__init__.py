"""setscore: gene-set signature analysis of single-cell data on Spark DataFrames.

Subpackages: ``sources`` (readers, fixtures), ``functions`` (Column builders),
``operators`` (DataFrame -> DataFrame steps), ``plans`` (reports and the
registered query catalog), ``streaming`` (none; inputs are read whole).
"""
