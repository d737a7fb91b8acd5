"""Fixed rule vocabularies of the platform (keyword lists, patterns,
codes).  They are the default parameters of the labelling operators;
every operator also accepts its own lexicon.
"""

# Emotion keyword cascade (checked in this order).
EMOTION_RULES = [
    ("urgent", "user", ["emergency", "urgent", "asap", "right now", "immediately", "sparks", "flooding",
                        "fire", "smoke"]),
    ("empathetic", "user", ["frustrated", "angry", "upset", "disappointed", "complaint", "problem", "issue",
                            "not working"]),
    ("apologetic", "response", ["sorry", "apologize", "apologies", "unfortunately", "regret"]),
    ("cheerful", "response", ["great news", "good news", "congratulations", "excellent", "perfect",
                              "wonderful"]),
]
EMOTION_SKILL_RULES = {
    "technical_skills": ["electrician", "plumber"], "technical_min_chars": 200,
    "legal_skills": ["lawyer"], "sales_skills": ["solar"],
}
EMOTIONS = ["neutral", "warm", "excited", "calm", "concerned", "apologetic", "confident", "empathetic",
            "urgent", "cheerful"]

# Query analysis vocabularies.
SIMPLE_PATTERNS = ["hello", "hi", "hey", "good morning", "good afternoon", "how are you", "what's up",
                   "thanks", "thank you", "bye", "goodbye", "yes", "no", "okay", "ok", "sure"]
GREETING_PATTERNS = ["hello", "hi", "hey"]
QUESTION_WORDS = ["why", "how", "explain", "what if", "compare"]
REASONING_WORDS = ["because", "therefore", "analyze", "think"]

# Semantic turn-end patterns (applied to the lower-cased text).
TURN_END_PATTERNS = [r"\?$", r"[.!]$", r"thanks?$", r"please$", r"okay$", r"that'?s (all|it)$",
                     r"got it$", r"right\??$"]
TURN_CONTINUE_PATTERNS = [r"\b(and|but|so|because|if|when|while|although)\s*$",
                          r"\b(um+|uh+|er+|like)\s*$", r",\s*$", r"\.\.\.$",
                          r"\b(first|second|also|another)\b", r"^\s*(well|so|okay)\s*,?\s*$"]
BACKCHANNEL_PATTERNS = [r"^(uh[- ]?huh|mm[- ]?hmm?|yeah|yep|okay|ok|sure|right|got it|i see)$",
                        r"^(yes|no|maybe)$"]

# Interruption vocabularies.
BACKCHANNEL_WORDS = ["uh-huh", "uh huh", "mm-hmm", "mmhmm", "yeah", "yep", "yes", "okay", "ok", "sure",
                     "right", "got it", "i see", "interesting"]
CORRECTION_STARTERS = ["no wait", "actually", "i mean", "sorry", "let me", "hold on"]
CLARIFICATION_STARTERS = ["what", "sorry", "can you", "could you", "wait", "huh", "pardon"]

# Project workflow steps and filename patterns (step order).
STEP_NAMES = ["Scope of Work", "Spec Sections", "Arch/MEP Drawings", "Manufacturer Specs", "Sketches",
              "Taper Plan", "Manufacturer Details", "Takeoff Files", "Contract Files", "Misc Documents"]
FILE_PATTERNS = {
    1: ["scope", "sow", "work order", "project scope"],
    2: ["spec", "section 07", "section 05", "division"],
    3: ["a-", "arch", "dwg", "drawing", "plan", "elevation", "detail", "roof"],
    4: ["warranty", "assembly", "manufacturer", "gaf", "carlisle", "firestone"],
    5: ["sketch", "markup", "redline", "field"],
    6: ["taper", "slope", "cricket", "saddle"],
    7: ["detail", "cad detail", "typical"],
    8: ["takeoff", "quantity", "estimate", "xls", "csv"],
    9: ["contract", "agreement", "terms", "payment"],
    10: ["misc", "other", "note", "photo"],
}
EXTENSION_STEPS = {".dwg": 3, ".dxf": 3, ".xls": 8, ".xlsx": 8, ".csv": 8, ".pdf": 10}
CRITICAL_DOCS = {1: "Scope of Work", 2: "Spec Sections (Division 07)", 3: "Architectural Drawings",
                 4: "Manufacturer Specifications"}

# Document codes (first three digits of a file name).
DOC_CODES = {
    "100": "Project Requirement / Scope", "200": "Architectural Plan", "260": "Plumbing Plan",
    "261": "Plumbing Plan", "270": "Mechanical Plan", "271": "Mechanical Plan", "274": "Mechanical Detail",
    "280": "Electrical Plan", "282": "Electrical Plan", "300": "Product Data", "302": "Product Data Submittal",
    "500": "Shop Drawing",
}

# Domain follow-up questions of the project dialogue, in cascade order
# (context word, filename fragment, question, answer lead).
DIALOGUE_RULES = [
    ("Plumbing", "26", "What plumbing penetrations or drains are shown?",
     "The plumbing plan details the following fixtures and locations: "),
    ("Mechanical", "27", "Where are the RTUs or mechanical units located?",
     "The mechanical plan indicates unit locations and curbs here: "),
    ("Electrical", "28", "Are there any electrical conduits or feeds on the roof?",
     "The electrical plan shows the following roof-mounted equipment: "),
    ("Submittal", "302", "What are the product specifications for this submittal?",
     "This product data submittal specifies: "),
]

# Training error categories – (category, severity, patterns) in check order.
ERROR_CATEGORIES = [
    ("CUDA_OOM", "recoverable", ["CUDA out of memory", "OutOfMemoryError", "tried to allocate"]),
    ("MODEL_LOAD_FAIL", "fatal", ["Failed to load model", "model not found", "404"]),
    ("DATA_FORMAT_ERROR", "user_action_required", ["ValueError", "KeyError", "invalid format"]),
    ("NETWORK_ERROR", "recoverable", ["ConnectionError", "TimeoutError", "network"]),
    ("GPU_UNAVAILABLE", "infrastructure", ["No CUDA GPUs are available", "CUDA not available"]),
]

# Voice modifiers appended to a persona description per emotion.
EMOTION_MODIFIERS = {
    "neutral": "", "warm": "speaking warmly and kindly", "excited": "speaking with enthusiasm and energy",
    "calm": "speaking in a soothing, relaxed manner", "concerned": "speaking with genuine concern",
    "apologetic": "speaking apologetically and sincerely", "confident": "speaking with confidence and authority",
    "empathetic": "speaking with deep empathy and understanding", "urgent": "speaking with urgency and importance",
    "cheerful": "speaking cheerfully and pleasantly",
}

# Supported file types – extension, category, display name.
FILE_TYPES = [
    ("pdf", "document", "PDF Document"), ("docx", "document", "Word Document"),
    ("doc", "document", "Word Document (Legacy)"), ("rtf", "document", "Rich Text Format"),
    ("odt", "document", "OpenDocument Text"), ("pages", "document", "Apple Pages"),
    ("xlsx", "spreadsheet", "Excel Spreadsheet"), ("xls", "spreadsheet", "Excel (Legacy)"),
    ("csv", "spreadsheet", "CSV File"), ("tsv", "spreadsheet", "TSV File"),
    ("ods", "spreadsheet", "OpenDocument Spreadsheet"),
    ("pptx", "presentation", "PowerPoint"), ("ppt", "presentation", "PowerPoint (Legacy)"),
    ("odp", "presentation", "OpenDocument Presentation"), ("key", "presentation", "Apple Keynote"),
    ("txt", "text", "Plain Text"), ("md", "text", "Markdown"), ("rst", "text", "reStructuredText"),
    ("log", "text", "Log File"),
    ("py", "code", "Python"), ("js", "code", "JavaScript"), ("ts", "code", "TypeScript"), ("java", "code", "Java"),
    ("cpp", "code", "C++"), ("c", "code", "C"), ("cs", "code", "C#"), ("go", "code", "Go"), ("rs", "code", "Rust"),
    ("rb", "code", "Ruby"), ("php", "code", "PHP"), ("sql", "code", "SQL"), ("sh", "code", "Shell Script"),
    ("bash", "code", "Bash Script"),
    ("json", "data", "JSON"), ("jsonl", "data", "JSON Lines"), ("xml", "data", "XML"), ("yaml", "data", "YAML"),
    ("yml", "data", "YAML"), ("toml", "data", "TOML"), ("ini", "data", "INI Config"),
    ("env", "data", "Environment File"),
    ("html", "web", "HTML"), ("htm", "web", "HTML"), ("xhtml", "web", "XHTML"), ("css", "web", "CSS"),
    ("scss", "web", "SCSS"), ("less", "web", "LESS"),
    ("eml", "email", "Email Message"), ("msg", "email", "Outlook Message"), ("mbox", "email", "Email Archive"),
    ("epub", "ebook", "EPUB eBook"), ("mobi", "ebook", "Kindle eBook"),
    ("png", "image", "PNG Image"), ("jpg", "image", "JPEG Image"), ("jpeg", "image", "JPEG Image"),
    ("gif", "image", "GIF Image"), ("webp", "image", "WebP Image"), ("bmp", "image", "Bitmap Image"),
    ("tiff", "image", "TIFF Image"), ("tif", "image", "TIFF Image"), ("svg", "image", "SVG Image"),
    ("heic", "image", "HEIC Image"),
    ("mp3", "audio", "MP3 Audio"), ("wav", "audio", "WAV Audio"), ("m4a", "audio", "M4A Audio"),
    ("ogg", "audio", "OGG Audio"), ("flac", "audio", "FLAC Audio"), ("aac", "audio", "AAC Audio"),
    ("wma", "audio", "WMA Audio"),
    ("mp4", "video", "MP4 Video"), ("mkv", "video", "MKV Video"), ("avi", "video", "AVI Video"),
    ("mov", "video", "MOV Video"), ("wmv", "video", "WMV Video"), ("webm", "video", "WebM Video"),
    ("flv", "video", "FLV Video"),
    ("zip", "archive", "ZIP Archive"), ("tar", "archive", "TAR Archive"), ("gz", "archive", "GZIP Archive"),
    ("tgz", "archive", "TAR.GZ Archive"), ("rar", "archive", "RAR Archive"), ("7z", "archive", "7-Zip Archive"),
    ("srt", "subtitle", "SRT Subtitles"), ("vtt", "subtitle", "WebVTT Subtitles"), ("ass", "subtitle", "ASS Subtitles"),
    ("ssa", "subtitle", "SSA Subtitles"),
]

# Turn-end scoring – base, per end pattern, per continue pattern,
# pending-question bonus, length adjustment and its word bounds, backchannel
# and empty-text scores.
TURN_SCORE = {"base": 0.5, "end": 0.3, "continue": 0.4, "question_pending": 0.2, "length": 0.1,
              "long_words": 10, "short_words": 3, "backchannel": 0.9, "empty": 0.5}

# Interruption thresholds (milliseconds, words).
INTERRUPTION = {"backchannel_max_ms": 500, "barge_in_min_ms": 300, "barge_in_min_words": 2}

# Query analysis word bounds and confidences.
QUERY_ANALYSIS = {"simple_max_words": 5, "complex_min_words": 30, "simple_confidence": 0.95,
                  "default_confidence": 0.8}

# Backchannel class – speech longer than this encourages continuation.
BACKCHANNEL_LONG_SPEECH_MS = 5000
