"""Schemas of the property graph and of what is asked of it."""

from __future__ import annotations

ENTITIES = "id string, name string, type string, properties map<string,string>"
RELATIONS = "id string, name string, type string, inverse_name string, symmetric boolean, properties map<string,string>"
TRIPLES = "id string, subject_id string, relation_id string, object_id string, confidence double, properties map<string,string>"
QUESTIONS = "query_id long, session_id string, text string"
MESSAGES = "session_id string, seq int, role string, content string"
VERSIONS = "version_id string, graph string, number int, description string, author string, created timestamp"
CHANGES = "version_id string, kind string, id string, change string"
