"""Whole flows: documents to chunks and keywords, text to graph, questions to answers; and the stated queries."""
