"""Values that results depend on, stated as they are."""

# Attack signatures (category, pattern, weight, weakness, technique, description).
SIGNATURES = (
    ("SQL_INJECTION", r"(\b(?:UNION\s+ALL\s+SELECT|UNION\s+SELECT|SELECT\s+.*?\s+FROM|INSERT\s+INTO|UPDATE\s+.*?\s+SET|DELETE\s+FROM|DROP\s+TABLE|ALTER\s+TABLE)\b)", 30, "CWE-89", "T1190", "SQL DML/DDL statement injection"),
    ("SQL_INJECTION", r"(\b(?:SLEEP\s*\(\s*\d+\s*\)|BENCHMARK\s*\(\s*\d+|WAITFOR\s+DELAY\b|PG_SLEEP\s*\(\s*\d+\s*\)))", 35, "CWE-89", "T1190", "Time-based blind SQL injection payload"),
    ("SQL_INJECTION", r"('(?:--|#|/\*)|'\s*OR\s+'?\d+'?='?\d+'?|'\s*OR\s+1=1|\bOR\s+1=1\b)", 25, "CWE-89", "T1190", "Tautological Boolean SQL authentication bypass"),
    ("XSS", r"(<script\b[^>]*>.*?</script>|<script\b|javascript:\s*[\w(]|vbscript:)", 30, "CWE-79", "T1059.007", "Inline or embedded JavaScript execution tag"),
    ("XSS", r"(\b(?:onerror|onload|onmouseover|onclick|onfocus|onblur|ontoggle|onanimationstart)\s*=\s*['\"]?[^'\">]+)", 25, "CWE-79", "T1059.007", "HTML DOM Event handler execution vector"),
    ("XSS", r"(\b(?:document\.cookie|document\.domain|window\.location|eval\s*\(|Function\s*\()|alert\s*\(|prompt\s*\(|confirm\s*\()", 25, "CWE-79", "T1059.007", "DOM manipulation or reflective dialog execution"),
    ("COMMAND_INJECTION", r"(;\s*(?:cat\s+/etc/passwd|ls\s+-la|whoami|uname\s+-a|id|pwd|netstat|ipconfig|ifconfig|curl\s+|wget\s+)|\|\s*(?:bash|sh|cmd\.exe|powershell))", 35, "CWE-78", "T1059", "Chained shell system command invocation"),
    ("COMMAND_INJECTION", r"(`(?:id|whoami|cat\s+/etc/passwd|ls)`|\$\((?:id|whoami|cat\s+/etc/passwd|uname)\))", 30, "CWE-78", "T1059", "Subshell command substitution syntax"),
    ("COMMAND_INJECTION", r"(/bin/(?:bash|sh|zsh|dash)|cmd\.exe|powershell(?:\.exe)?\s+(?:-nop|-w\s+hidden|-enc))", 35, "CWE-78", "T1059", "Direct shell interpreter execution"),
    ("PATH_TRAVERSAL_LFI", r"(\.\./\.\./|\.\.\\\.\.\\|%2e%2e%2f|%252e%252e%252f|\.\./|\.\.\\)", 20, "CWE-22", "T1006", "Directory traversal relative path escape sequence"),
    ("PATH_TRAVERSAL_LFI", r"(/etc/(?:passwd|shadow|hosts|issue|os-release)|c:[\\/]windows[\\/]win\.ini|php://(?:filter|input|expect)|file://)", 30, "CWE-22", "T1006", "Sensitive operating system file disclosure or PHP wrapper"),
    ("SSTI", r"(\{\{\s*(?:7\*7|config|self|request|class|mro|subclasses)\s*\}\}|\$\{.*\}|<%=\s*.*?\s*%>|\[\[\s*.*?\s*\]\])", 30, "CWE-1336", "T1190", "Template engine expression injection (Jinja2, Twig, Freemarker, Spring)"),
    ("SSRF", r"(https?://(?:127\.0\.0\.1|localhost|0\.0\.0\.0|169\.254\.169\.254|metadata\.google\.internal|10\.\d+\.\d+\.\d+|192\.168\.\d+\.\d+))", 25, "CWE-918", "T1090", "Loopback, RFC1918 private IP, or cloud metadata IP access attempt"),
    ("XXE", r"(<!DOCTYPE\s+\w+\s+\[\s*<!ENTITY\s+\w+\s+SYSTEM\s+['\"][^'\"]+['\"]|\bSYSTEM\s+['\"](?:file://|http://))", 35, "CWE-611", "T1190", "XML External Entity declaration"),
    ("PROTOTYPE_POLLUTION", r"(__proto__|constructor\.prototype|prototype\[['\"]?\w+['\"]?\])", 25, "CWE-1321", "T1190", "JavaScript Prototype chain pollution vector"),
)

# Script obfuscation (category, pattern, weight, description).
OBFUSCATIONS = (
    ("DYNAMIC_EVAL_WRAPPER", r"(\b(?:eval|Function|execScript|setTimeout|setInterval)\s*\(\s*(?:atob|Buffer\.from|String\.fromCharCode|unescape|decodeURIComponent))", 35, "Dynamic code execution wrapper decoding encoded/obfuscated strings"),
    ("BRACKET_PROPERTY_LOOKUP", r"(\b(?:window|this|self|globalThis|top|parent)\s*\[\s*['\"][^'\"]+['\"]\s*\+\s*['\"][^'\"]+['\"])", 25, "Bracket notation computed property evasion (e.g. window['ev'+'al'])"),
    ("STRING_CONCATENATION_EVASION", r"((?:['\"][a-zA-Z0-9_\-\.]{1,4}['\"]\s*\+\s*){2,}['\"][a-zA-Z0-9_\-\.]{1,4}['\"])", 20, "Fragmented string literal concatenation to evade keyword filters"),
    ("SHELL_ENV_SPLITTING", r"(\$\{IFS\}|\$@|\$\*|\$u|\$1|\$9|\$\{\w+:\d+:\d+\})", 25, "Bash/sh environment variable substitution and IFS whitespace evasion"),
    ("SHELL_QUOTE_ESCAPE_INSERTION", r"(\b[a-zA-Z]{1,3}(?:''|\"\")[a-zA-Z]{1,4}|\\[a-zA-Z]\\[a-zA-Z])", 20, "Bash command quote insertion or backslash escaping (e.g., c''at or \\c\\a\\t)"),
    ("HEX_OCTAL_ESCAPED_IDENTIFIERS", r"((?:\\x[0-9a-fA-F]{2}){2,}|(?:\\u[0-9a-fA-F]{4}){2,}|(?:\\0[0-7]{2}){2,})", 20, "Repeated hex, unicode, or octal escaped byte sequences"),
    ("POWERSHELL_BACKTICK_SPLIT", r"(`[a-zA-Z]`[a-zA-Z]`[a-zA-Z]|(?:iex|Invoke-Expression)\s*\(|\[Convert\]::FromBase64String)", 30, "PowerShell backtick keyword obfuscation or Invoke-Expression payload"),
    ("HEX_ENCODED_IP_ADDRESS", r"(\b0x[0-9a-fA-F]{8}\b|\b0[0-7]{10,12}\b|\b2130706433\b)", 25, "Hex, octal, or dword encoded IP address to bypass SSRF URL sanitizers"),
    ("SQL_COMMENT_SPLITTING", r"(/\*![\s\S]*?\*/|/\*[\s\S]*?\*/\s*(?:SELECT|UNION|FROM|WHERE))", 25, "MySQL conditional comment execution (/*!...*/) or inline comment evasion"),
    ("OBFUSCATED_VAR_NAMES", r"(\b_0x[a-f0-9]{4,6}\b|\b[a-zA-Z0-9_$]{1,2}\s*=\s*\[[\s\S]{10,}\])", 15, "JavaScript packer identifier mangling (e.g., Javascript-Obfuscator _0x hex names)"),
)
ZERO_WIDTH = ("ZERO_WIDTH_CHARACTER_INTERLEAVING", "[\u200b\u200c\u200d\ufeff\u00ad]", 30, "Zero-width spaces or soft hyphens inserted to defeat string matching filters")
PLUS_DENSITY = ("EXCESSIVE_CONCATENATION_DENSITY", 5, 200, 15)
HINTS = (
    (("DYNAMIC_EVAL_WRAPPER",), "Normalize dynamic code execution: isolate decoder arguments and trace decoded AST."),
    (("BRACKET_PROPERTY_LOOKUP", "STRING_CONCATENATION_EVASION"), "Fold constant string concatenations (e.g. 'e'+'v'+'a'+'l' -> 'eval') prior to inspection."),
    (("SHELL_ENV_SPLITTING", "SHELL_QUOTE_ESCAPE_INSERTION"), "Normalize shell tokens by stripping empty quotes, IFS variables, and bash backslashes."),
    (("ZERO_WIDTH_CHARACTER_INTERLEAVING",), "Sanitize input with NFKC unicode normalization and strip zero-width characters (\\u200B-\\u200D, \\uFEFF)."),
)
NO_HINT = "Payload exhibits standard un-obfuscated grammar."
EMPTY_HINT = "Empty or non-string payload."

# Scripts inside files (description, pattern).
SCRIPTS = (
    ("HTML/SVG <script> block", r"(<script\b[^>]*>[\s\S]*?</script>)"),
    ("javascript: URI scheme handler", r"(javascript:\s*[\w(])"),
    ("Executable JS function call", r"(\b(?:alert|eval|confirm|prompt|Function)\s*\([^)]*\))"),
    ("GIF/Image comment assignment polyglot trick", r"(/\*[\s\S]*?\*/\s*=\s*[\w\d]+)"),
    ("DOM credential access call", r"(\bdocument\.cookie\b|\bwindow\.location\b)"),
    ("Embedded onload attribute", r"(onload\s*=\s*['\"][^'\"]+['\"])"),
)
PHP = (
    ("Embedded PHP code block", r"(<\?(?:php|=)[\s\S]*?\?>)"),
    ("PHP webshell execution hook", r"(\b(?:eval|system|passthru|shell_exec|exec|assert)\s*\(\s*\$_(?:GET|POST|REQUEST|COOKIE))"),
)
SHEBANG = "Shell script shebang (#!/bin/sh)"
ZIP_ANOMALY = "ZIP central directory / local file header embedded inside image stream"
# Classes of files in more than one format, in order (class, risk, anomaly, advice).
POLYGLOTS = {
    "gif": ("GIF_JAVASCRIPT_POLYGLOT", 95.0, "Valid GIF header followed by JavaScript block comment closure (GIF89a/* trick)", ("Strictly validate MIME headers and force Content-Disposition: attachment for uploaded images.", "Re-encode images through an image processing pipeline (stripping non-image byte streams).")),
    "png": ("PNG_PHP_WEBSHELL_POLYGLOT", 98.0, "Valid PNG image header with embedded executable PHP web shell tags", ("Store uploads on dedicated static CDN without PHP engine handler mapping (.php extension restrictions).",)),
    "pdf": ("PDF_ACTION_SCRIPT_POLYGLOT", 90.0, "PDF document stream contains /JavaScript or /Launch interactive actions", ("Flatten uploaded PDFs or strip interactive /Names /JavaScript catalog dictionaries.",)),
    "jpeg": ("JPEG_ZIP_ARCHIVE_POLYGLOT", 88.0, "Dual-format JPEG image concatenated with ZIP archive file tables (stego-dropper)", ("Verify image EOF markers (\xff\xd9 for JPEG) and truncate all trailing data.",)),
    "svg": ("SVG_SCRIPT_INJECTION_POLYGLOT", 92.0, "SVG vector graphic containing active scripting elements or event handlers", ("Sanitize SVG XML through DOMPurify or render via <img> tag with Content-Security-Policy sandbox.",)),
    "hybrid": (None, 75.0, None, ("Enforce single strict content-type validation and prevent dual-execution handlers.",)),
    "embedded": (None, 85.0, None, ("Disallow raw binary uploads to be served with executable browser MIME types.",)),
    "none": ("MONOLITHIC_PAYLOAD", 10.0, None, ("Standard input validation and Content-Type verification sufficient.",)),
}

# Machine-code indicators (name, points, pattern over bytes as Latin-1, text).
CODE_BYTES = (
    ("poly_nop", 0.3, "[\\x40-\\x4f]{8,}", "x86 32-bit polymorphic single-byte slide (INC/DEC series)"),
    ("call_pop", 0.4, "\\xe8\\x00\\x00\\x00\\x00[\\x58-\\x5f]", "x86 Call/Pop GetPC routine (call $+5; pop reg)"),
    ("fpu", 0.45, "\\xd9\\xee|\\xd9\\x74\\x24", "x87 FPU fnstenv/fstenv GetPC exploit pattern"),
    ("syscall", 0.35, "\\x0f\\x05", "x86_64 SYSCALL instruction opcode (0x0F 0x05)"),
    ("int80", 0.35, "\\xcd\\x80", "Linux x86 int 0x80 syscall interrupt (0xCD 0x80)"),
    ("sysenter", 0.35, "\\xcd\\x2e|\\x0f\\x34", "Windows native KiFastSystemCall/sysenter (0x0F 0x34 or 0xCD 0x2E)"),
    ("xor_loop", 0.3, "[\\x30-\\x33][\\xc0-\\xff].{1,16}[\\x75\\xe2]", "Self-decrypting XOR loop stub with conditional branch"),
)

# Baseline weights by byte class, universal hash family.
BASELINE = ((97, 122, 0.025), (65, 90, 0.008), (48, 57, 0.015))
BASELINE_MARKS, BASELINE_MARK, BASELINE_REST = (32, 44, 46, 58, 59, 61, 38, 47, 63, 45, 95), 0.012, 0.0001
PRIME = 4294967311
HASH_A, HASH_B, HASHES = (1103515245, 12345), (214013, 2531011), 128


def baseline() -> list[float]:
    """The normalised baseline of bytes."""
    weights = [next((w for lo, hi, w in BASELINE if lo <= b <= hi), BASELINE_MARK if b in BASELINE_MARKS else BASELINE_REST) for b in range(256)]
    return [w / sum(weights) for w in weights]


def hash_family() -> list[tuple[int, int]]:
    """(a, b) of each permutation."""
    return [((HASH_A[0] * (i + 1) + HASH_A[1]) % (PRIME - 1) + 1, (HASH_B[0] * (i + 1) + HASH_B[1]) % PRIME) for i in range(HASHES)]
