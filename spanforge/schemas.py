"""Schemas of the tables and files that the engine reads and writes."""

from __future__ import annotations

SOURCE = "struct<file_path: string, first_character_index: bigint, last_character_index: bigint>"
FILES = "file_path string, text string, mtime double, hash string"
CHUNKS = "chunk_id bigint, file_path string, chunk_no int, first_character_index bigint, last_character_index bigint"
QUESTIONS = f"question_id string, question string, answer string, sources array<{SOURCE}>"
DATASET = f"rag_questions array<struct<question_id: string, question: string, sources: array<{SOURCE}>, answer: string>>"
RESULTS = f"search_results array<struct<question_id: string, question: string, retrieved_sources: array<{SOURCE}>, answer: string>>, k int"
REGISTRY = "file_path string, mtime double, hash string, chunks int"
