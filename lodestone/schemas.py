"""Schemas of the model's tables."""

FILES = "file_path string, file_size long, mtime double, content_hash string, status string, indexed_at double, chunk_count long, error string"
SCANNED = "path string, size long, mtime double, file_type string, extension string"
CHUNKS = "source_file string, chunk_index int, char_offset int, text string, metadata map<string,string>"
VECTORS = "file_path string, chunk_index int, text string, file_type string, embedding array<float>"
JOURNAL = "ref decimal(20,0), parent_ref decimal(20,0), usn long, reason long, attrs long, name string, is_directory boolean"
EXTRACTED = "file_path string, file_type string, text string, metadata map<string,string>, error string"
