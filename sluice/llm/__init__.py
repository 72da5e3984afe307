"""Training-data operators: ten corpus operators and their registered queries.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries when the folder is present.
"""
