"""Training-data operators: ten large-corpus steps and the queries that apply them.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries only when the folder is there.
"""
