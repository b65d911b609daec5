"""Spark schemas of the entities."""

DOCUMENT = "document_id string, filename string, source string, document_type string, title string, text string, metadata map<string,string>, ingestion_timestamp string"
CHUNK = "chunk_id string, document_id string, chunk_index int, chunk_text string, char_start int, char_end int, metadata map<string,string>"
QUERY_RECORD = "question_id string, domain string, english string, tamil_english string, hindi_english string, script_type string, category string, expected_document_ids array<string>, difficulty string"
SPAN = "array<struct<start int, `end` int, language string, text string>>"
LANGUAGES = ("english", "tamil_english", "hindi_english")
CONDITIONS = tuple(f"{language}_{side}" for language in LANGUAGES for side in ("baseline", "mitigated"))
