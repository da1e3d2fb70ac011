"""Schemas of the engine's relations."""

from __future__ import annotations

#: Stored chunks: exactly these fields, none empty, page from 1.
CHUNK_FIELDS = ("chunk_id", "paper", "page", "text")
CHUNKS = "chunk_id string, paper string, page int, text string"
#: Chunks as operators take them; ties are broken by (paper, page, position), the order in which papers are read.
POSITIONED_CHUNKS = "chunk_id string, paper string, page int, position int, text string"
ORDER = ("paper", "page", "position")
EVIDENCE = "struct<chunk_id:string,paper:string,page:int,text:string,score:double>"
PLAN = "struct<queries:array<string>,entities:array<string>,targets:array<string>,facets:array<string>,retrievers:array<string>,output_language:string>"
VERIFICATION = "struct<status:string,covered:map<string,map<string,array<string>>>,missing:array<string>,corrective_query:string>"
#: One row per question.
STATE = f"qid string, question string, plan {PLAN}, evidence array<{EVIDENCE}>, verification {VERIFICATION}, retry_count int, stop_reason string, answer string"
