"""They decide results and must not change."""

#: Extensions of each type, the types in the order in which they are tried.
EXTENSIONS = {
    "text": [".txt", ".md", ".csv", ".json", ".xml", ".html", ".log", ".yaml", ".yml", ".ini", ".cfg", ".conf", ".rst", ".tex"],
    "pdf": [".pdf"],
    "docx": [".docx"],
    "audio": [".mp3", ".wav", ".flac", ".m4a", ".ogg", ".wma", ".aac"],
    "video": [".mp4", ".avi", ".mkv", ".mov", ".webm", ".wmv", ".flv"],
    "image": [".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp", ".webp"],
    "msg": [".msg"],
}
#: Megabytes of the largest file of each type.
TYPE_MAX_MB = {"text": 100, "pdf": 500, "docx": 200, "image": 50, "msg": 200, "audio": 2000, "video": 5000}
GLOBAL_MAX_MB = 500
EXCLUDED_DIRS = ["$recycle.bin", "system volume information", "$windows.~bt", "$windows.~ws", "windows", "recovery", ".git", "__pycache__", "node_modules", ".venv", "venv"]
GPU_TYPES = ["audio", "video"]

#: Chunk separators in order of priority.
SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " "]

#: Words that no query keyword is.
STOP_WORDS = """
i me my mine we us our you your he him his she her it its they them their
this that these those what which who whom when where how why
a an the is am are was were be been being have has had having do does did doing
will would could should may might can shall
and but or so if then than as at of in on to for with by from about into
through during before after above below between up down out off over under again further
not no nor only own same too very just also now here there all each every
both few more most some any other such get put find show tell give make use used
list table please help need want much many
""".split()

#: Nouns that make the word before them, ending in s, a name.
ATTRIBUTE_NOUNS = """
email emails address addresses phone number numbers birthday details detail contact contacts
info information name account accounts file files message messages letter letters photo photos
document documents order orders key keys password passwords code codes certificate data record records resume cv
""".split()

#: Words in s that are no names.
COMMON_WORDS_S = """
windows accounts results address always class items does has was this plus less across
others status process success access business various previous serious focus thanks bonus
campus virus canvas basis crisis analysis
""".split()

BROAD = r"\b(find\s+(me\s+)?all|show\s+(me\s+)?all|list\s+(me\s+)?all|every\s+(single\s+)?\w+|all\s+(my|the)\b|everything|gather\s+(all|every))\b"
SYSTEM_PATH = r"(qdrant_data[\\/]|__pycache__|\w+\.egg-info|node_modules|[\\/]\.git[\\/]|applied_seq\.json|collection_config\.json)"
KEYWORD = r"\b[a-zA-Z][a-zA-Z'-]*\b"
AFTER_PREPOSITION = r"\b(?:for|from|to|about|regarding|with)\s+([a-zA-Z][a-zA-Z'-]*(?:\s+[a-zA-Z][a-zA-Z'-]*)?)"
POSSESSIVE = r"\b([a-zA-Z][a-zA-Z'-]*)'s\s+(\w+)"
POSSESSIVE_S = r"\b([a-zA-Z][a-zA-Z'-]{1,})s\s+(\w+)"

#: What makes a table row say that there is nothing; NA with a word's bounds, and as anywhere in a cell.
_NOTHING = r"\|[^|]*(?:Not\s+applicable|{na}|No\s+(?:code|key|serial|software|data)\s+found|Not\s+a\s+software\s+code|None\s+found|No\s+relevant|No\s+specific\s+\w+\s+(?:key|code|serial|license)|\(No\s+specific|not\s+visible\s+in\s+the\s+text|not\s+(?:fully\s+)?provided\s+in\s+the|(?:key|code)\s+provided\s+in\s+the\s+email\s+body|not\s+(?:fully\s+)?visible|requires?\s+further\s+inspection|does\s+not\s+constitute\s+proof|Note:\s+If\s+you\s+still\s+have|not\s+(?:a\s+)?(?:license|software|product)\s+(?:key|code))[^|]*\|"
NOTHING_ROW = _NOTHING.replace("{na}", r"\bN/?A\b")
NOTHING_ROW_COMPAT = _NOTHING.replace("{na}", r"N/?A")
_DISCLAIMER = r"(?:\*{0,2}(?:Note|Please note)\*{0,2}):?\s*.*(?:Not applicable|not contain|do not contain|no.*license|no.*key|no.*code|noted as such|not fully visible|further inspection|not visible|obscured|partially.*visible|only.*visible|only.*readable).*$"
DISCLAIMER = r"(?:^|\n+)" + _DISCLAIMER
DISCLAIMER_COMPAT = r"\n*" + _DISCLAIMER

#: Bits of a change record's reason.
REASON = {"overwrite": 0x1, "extend": 0x2, "truncate": 0x4, "create": 0x100, "delete": 0x200, "rename_old": 0x1000, "rename_new": 0x2000, "basic_info": 0x8000, "close": 0x80000000}
CONTENT_CHANGE = 0x1 | 0x2 | 0x4 | 0x100 | 0x200 | 0x2000 | 0x8000
DIRECTORY = 0x10

#: Ordered rules of the error taxonomy: (category, needles as written, needles in any case[, the pattern of a reason that the category names]).
ERROR_RULES = [
    ("Unknown code page (corrupt .msg encoding)", ["Unknown code page"], []),
    ("Module attribute error", ["has no attribute"], []),
    ("Failed to open MSG", ["Failed to open MSG"], [], r"\.msg:\s*(.+)"),
    ("No text extracted (empty file)", ["No text extracted"], []),
    ("Missing dependency", ["not installed"], []),
    ("Extraction timeout", [], ["timeout", "timed out"]),
    ("Permission/access denied", ["Permission", "Access"], []),
    ("Corrupt/invalid file", [], ["corrupt", "invalid"]),
    ("Memory error", ["MemoryError"], ["memory"]),
    ("Unicode/encoding error", ["UnicodeDecodeError", "codec"], []),
    ("PDF extraction error", ["PDF", "pdf"], []),
]
EXTRACTION_RULES = [
    ("FFmpeg audio extraction failed", ["ffmpeg failed"], []),
    ("File not found / access error", ["Cannot read file", "No such file"], []),
    ("Extraction timeout", [], ["timed out"]),
    ("MSG/Outlook extraction failed", ["extract_msg", "MSG"], []),
    ("PDF extraction failed", ["PDF", "PyMuPDF"], []),
    ("Image OCR failed", ["OCR", "tesseract"], []),
    ("Permission denied", [], ["permission", "access denied"]),
    ("Text encoding error", [], ["encoding", "decode"]),
    ("Corrupted/invalid file", [], ["corrupt", "invalid"]),
]
