"""Fixed values that results depend on. Stated plainly, in their natural order."""

from __future__ import annotations

# Bytes inspected for MIME / binary detection, and the control-byte rule
# (at least 3 control bytes and more than 1 percent of the inspected prefix).
DETECTION_BYTES = 8192
MIN_CONTROL_BYTES = 3
MAX_CONTROL_PERCENT = 1
DEFAULT_MAX_SIZE = 1_048_576

# Built-in exclusion patterns (glob syntax, trailing "/" = directories only).
DEFAULT_EXCLUDES = [
    "target/",
    "node_modules/",
    "dist/",
    "build/",
    ".next/",
    ".nuxt/",
    ".svelte-kit/",
    ".turbo/",
    ".cache/",
    "coverage/",
    "__pycache__/",
    ".pytest_cache/",
    ".mypy_cache/",
    ".ruff_cache/",
    ".tox/",
    ".venv/",
    "venv/",
    ".gradle/",
    "cmake-build-debug/",
    "cmake-build-release/",
    "*.log",
    "logs/",
    ".log",
    "out/",
    "bin/",
    "obj/",
    "*.egg-info/",
    ".eggs/",
    ".pnp.*",
    ".yarn/",
    "vendor/",
    "Pods/",
    ".idea/",
    ".vscode/",
    "*.swp",
    "*.swo",
    ".DS_Store",
    ".nyc_output/",
    "htmlcov/",
    ".coverage",
    "test-results/",
    "playwright-report/",
    "tmp/",
    "temp/",
    ".tmp/",
    "Thumbs.db",
    "desktop.ini",
    "*.mp4",
    "*.zip",
    "*.tar.gz",
    "*.pdf",
    "public/uploads/",
    "storage/",
    "data/",
    ".env.local",
    ".env.*.local",
    ".git/",
    "Cargo.lock",
]

# MIME types that count as text even when a content signature names them.
TEXTUAL_MIMES = [
    "application/json",
    "application/ld+json",
    "application/javascript",
    "application/postscript",
    "application/rtf",
    "application/xml",
    "application/xhtml+xml",
    "application/x-x509-ca-cert",
    "image/svg+xml",
]

# Content signatures from the public format specifications.
# Each entry: (name, [(byte offset, hex bytes), ...] all of which must match, MIME, extension).
# Checked in this order; the first match wins.
SIGNATURES = [
    ("png", [(0, "89504E470D0A1A0A")], "image/png", "png"),
    ("jpeg", [(0, "FFD8FF")], "image/jpeg", "jpg"),
    ("gif", [(0, "474946")], "image/gif", "gif"),
    ("webp", [(0, "52494646"), (8, "57454250")], "image/webp", "webp"),
    ("cr2", [(0, "49492A00"), (8, "4352")], "image/x-canon-cr2", "cr2"),
    ("tiff_le", [(0, "49492A00")], "image/tiff", "tif"),
    ("tiff_be", [(0, "4D4D002A")], "image/tiff", "tif"),
    ("bmp", [(0, "424D")], "image/bmp", "bmp"),
    ("jxr", [(0, "4949BC")], "image/vnd.ms-photo", "jxr"),
    ("psd", [(0, "38425053")], "image/vnd.adobe.photoshop", "psd"),
    ("ico", [(0, "00000100")], "image/vnd.microsoft.icon", "ico"),
    ("avif", [(4, "6674797061766966")], "image/avif", "avif"),
    ("heif", [(4, "6674797068656963")], "image/heif", "heif"),
    ("mp4_isom", [(4, "6674797069736F6D")], "video/mp4", "mp4"),
    ("mp4_mp41", [(4, "667479706D703431")], "video/mp4", "mp4"),
    ("mp4_mp42", [(4, "667479706D703432")], "video/mp4", "mp4"),
    ("m4v", [(4, "667479704D345620")], "video/x-m4v", "m4v"),
    ("mov", [(4, "6674797071742020")], "video/quicktime", "mov"),
    ("mkv", [(0, "1A45DFA3")], "video/x-matroska", "mkv"),
    ("avi", [(0, "52494646"), (8, "41564920")], "video/x-msvideo", "avi"),
    ("flv", [(0, "464C5601")], "video/x-flv", "flv"),
    ("mpeg", [(0, "000001BA")], "video/mpeg", "mpg"),
    ("mp3_id3", [(0, "494433")], "audio/mpeg", "mp3"),
    ("mp3_frame", [(0, "FFFB")], "audio/mpeg", "mp3"),
    ("wav", [(0, "52494646"), (8, "57415645")], "audio/x-wav", "wav"),
    ("ogg", [(0, "4F676753")], "audio/ogg", "ogg"),
    ("flac", [(0, "664C6143")], "audio/x-flac", "flac"),
    ("midi", [(0, "4D546864")], "audio/midi", "mid"),
    ("amr", [(0, "2321414D52")], "audio/amr", "amr"),
    ("zip", [(0, "504B0304")], "application/zip", "zip"),
    ("zip_empty", [(0, "504B0506")], "application/zip", "zip"),
    ("tar", [(257, "7573746172")], "application/x-tar", "tar"),
    ("gzip", [(0, "1F8B08")], "application/gzip", "gz"),
    ("bzip2", [(0, "425A68")], "application/x-bzip2", "bz2"),
    ("xz", [(0, "FD377A585A00")], "application/x-xz", "xz"),
    ("7z", [(0, "377ABCAF271C")], "application/x-7z-compressed", "7z"),
    ("rar", [(0, "526172211A07")], "application/vnd.rar", "rar"),
    ("zstd", [(0, "28B52FFD")], "application/zstd", "zst"),
    ("lz4", [(0, "04224D18")], "application/x-lz4", "lz4"),
    ("pdf", [(0, "25504446")], "application/pdf", "pdf"),
    ("postscript", [(0, "2521")], "application/postscript", "ps"),
    ("rtf", [(0, "7B5C727466")], "application/rtf", "rtf"),
    ("sqlite", [(0, "53514C69746520666F726D6174203300")], "application/vnd.sqlite3", "sqlite"),
    ("elf", [(0, "7F454C46")], "application/x-executable", "elf"),
    ("exe", [(0, "4D5A")], "application/vnd.microsoft.portable-executable", "exe"),
    ("macho_32", [(0, "FEEDFACE")], "application/x-mach-binary", "macho"),
    ("macho_64", [(0, "FEEDFACF")], "application/x-mach-binary", "macho"),
    ("macho_32_le", [(0, "CEFAEDFE")], "application/x-mach-binary", "macho"),
    ("macho_64_le", [(0, "CFFAEDFE")], "application/x-mach-binary", "macho"),
    ("java_class", [(0, "CAFEBABE")], "application/java", "class"),
    ("wasm", [(0, "0061736D")], "application/wasm", "wasm"),
    ("dex", [(0, "6465780A")], "application/vnd.android.dex", "dex"),
    ("woff", [(0, "774F4646")], "application/font-woff", "woff"),
    ("woff2", [(0, "774F4632")], "application/font-woff", "woff2"),
    ("ttf", [(0, "0001000000")], "application/font-sfnt", "ttf"),
    ("otf", [(0, "4F54544F")], "application/font-sfnt", "otf"),
    ("ole2", [(0, "D0CF11E0A1B11AE1")], "application/x-ole-storage", "msi"),
    ("xml", [(0, "3C3F786D6C20")], "text/xml", "xml"),
    ("shebang", [(0, "2321")], "text/x-shellscript", "sh"),
]

# MIME type by lower-cased file extension (common types from the public
# IANA registry and the Apache mime.types list).
EXTENSION_MIMES = [
    ("7z", "application/x-7z-compressed"),
    ("aac", "audio/aac"),
    ("avi", "video/x-msvideo"),
    ("avif", "image/avif"),
    ("bash", "application/x-sh"),
    ("bin", "application/octet-stream"),
    ("bmp", "image/bmp"),
    ("bz2", "application/x-bzip2"),
    ("c", "text/x-c"),
    ("cc", "text/x-c"),
    ("class", "application/java-vm"),
    ("conf", "text/plain"),
    ("cpp", "text/x-c"),
    ("cs", "text/plain"),
    ("css", "text/css"),
    ("csv", "text/csv"),
    ("cxx", "text/x-c"),
    ("dll", "application/x-msdownload"),
    ("doc", "application/msword"),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("eot", "application/vnd.ms-fontobject"),
    ("epub", "application/epub+zip"),
    ("exe", "application/x-msdownload"),
    ("flac", "audio/flac"),
    ("gif", "image/gif"),
    ("go", "text/plain"),
    ("gz", "application/gzip"),
    ("h", "text/x-c"),
    ("hpp", "text/x-c"),
    ("htm", "text/html"),
    ("html", "text/html"),
    ("ico", "image/x-icon"),
    ("ics", "text/calendar"),
    ("ini", "text/plain"),
    ("ipynb", "application/x-ipynb+json"),
    ("jar", "application/java-archive"),
    ("java", "text/x-java-source"),
    ("jpeg", "image/jpeg"),
    ("jpg", "image/jpeg"),
    ("js", "application/javascript"),
    ("json", "application/json"),
    ("jsonld", "application/ld+json"),
    ("jsx", "text/jsx"),
    ("kt", "text/plain"),
    ("log", "text/plain"),
    ("lua", "text/x-lua"),
    ("m4a", "audio/mp4"),
    ("markdown", "text/markdown"),
    ("md", "text/markdown"),
    ("mid", "audio/midi"),
    ("midi", "audio/midi"),
    ("mjs", "application/javascript"),
    ("mkv", "video/x-matroska"),
    ("mov", "video/quicktime"),
    ("mp3", "audio/mpeg"),
    ("mp4", "video/mp4"),
    ("mpeg", "video/mpeg"),
    ("mpg", "video/mpeg"),
    ("odp", "application/vnd.oasis.opendocument.presentation"),
    ("ods", "application/vnd.oasis.opendocument.spreadsheet"),
    ("odt", "application/vnd.oasis.opendocument.text"),
    ("oga", "audio/ogg"),
    ("ogg", "audio/ogg"),
    ("ogv", "video/ogg"),
    ("otf", "font/otf"),
    ("pdf", "application/pdf"),
    ("php", "application/x-httpd-php"),
    ("pl", "text/x-perl"),
    ("png", "image/png"),
    ("ppt", "application/vnd.ms-powerpoint"),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ("ps", "application/postscript"),
    ("py", "text/x-python"),
    ("rar", "application/vnd.rar"),
    ("rb", "text/x-ruby"),
    ("rs", "text/x-rust"),
    ("rtf", "application/rtf"),
    ("sass", "text/x-sass"),
    ("scss", "text/x-scss"),
    ("sh", "application/x-sh"),
    ("sql", "application/sql"),
    ("svg", "image/svg+xml"),
    ("swift", "text/plain"),
    ("tar", "application/x-tar"),
    ("tif", "image/tiff"),
    ("tiff", "image/tiff"),
    ("toml", "text/x-toml"),
    ("ts", "video/mp2t"),
    ("tsv", "text/tab-separated-values"),
    ("tsx", "text/tsx"),
    ("ttf", "font/ttf"),
    ("txt", "text/plain"),
    ("wasm", "application/wasm"),
    ("wav", "audio/wav"),
    ("weba", "audio/webm"),
    ("webm", "video/webm"),
    ("webp", "image/webp"),
    ("woff", "font/woff"),
    ("woff2", "font/woff2"),
    ("xhtml", "application/xhtml+xml"),
    ("xls", "application/vnd.ms-excel"),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("xml", "text/xml"),
    ("xz", "application/x-xz"),
    ("yaml", "text/x-yaml"),
    ("yml", "text/x-yaml"),
    ("zip", "application/zip"),
    ("zst", "application/zstd"),
]

# Labels of the MIME detection method.
DETECTED_BY_CONTENT = "content signature"
DETECTED_BY_EXTENSION = "file extension"
DETECTED_BY_FALLBACK = "fallback"
FALLBACK_MIME = "application/octet-stream"
