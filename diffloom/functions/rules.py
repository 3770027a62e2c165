"""Rule tables.

Everything in this module is a fixed value: the lists, patterns and numbers
have to stay as they are for results to be comparable.  Patterns keep their
Python spelling because some of them are shown in reports.
"""

from __future__ import annotations

# --- risk scoring: path patterns (case-insensitive), first hit counts -------
HIGH_RISK_PATHS = [
    r"auth", r"security", r"crypto", r"login", r"payment", r"database|db_", r"migration", r"schema",
    r"api[/_]", r"core[/_]", r"config", r"middleware",
]
ELEVATED_PATHS = [
    r"service", r"controller", r"handler", r"router", r"model", r"interface", r"abstract",
    r"base[/_]", r"manager", r"factory",
]

# --- risk scoring: content patterns as (pattern, flags) ---------------------
DANGEROUS_CONTENT = [
    (r"\bmemcpy\b|\bmemmove\b|\bstrcpy\b|\bsprintf\b", ""),
    (r"\beval\s*\(", ""),
    (r"\bexec\s*\(", ""),
    (r"\bos\.system\b", ""),
    (r"\bsubprocess\b", ""),
    (r"\bpickle\.loads?\b", ""),
    (r"\bunsafe\b", "i"),
    (r"TODO.*(security|vuln|hack|fixme)", "i"),
    (r"\bdelete\s+\[\]|\bfree\s*\(", ""),
    (r"\bnew\s+\w+\s*\[", ""),
    (r"\bvirtual\b.*\bdestructor\b|\bvirtual\s+~", ""),
]
NOTABLE_CONTENT = [
    (r"\bthrow\b|\braise\b", ""),
    (r"\basync\b|\bawait\b", ""),
    (r"\bthread\b|\bmutex\b|\block\b", "i"),
    (r"\bpublic\b.*\binterface\b|\bpublic\s+API\b", "i"),
    (r"\boverride\b|\bvirtual\b", ""),
    (r"\bimport\s+\*|\busing\s+namespace\b", ""),
]
SENSITIVE_EXTENSIONS = ["sql", "sh", "bat", "ps1", "cmd"]
RISK_ICONS = {"Low": "\U0001f7e2", "Med": "\U0001f7e1", "High": "\U0001f534"}

# --- comment-only hunks -----------------------------------------------------
COMMENT_STARTS = {"py": ["#", '"""', "'''"]}
COMMENT_STARTS_OTHER = ["//", "/*", "*", "<!--"]

# --- touched symbols: patterns per language, extensions per language --------
_ARROW_OR_FUNCTION = (
    r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))"
)
SYMBOL_PATTERNS = {
    "cpp": [
        r"^[\w\*&:<>,\s]+\s+(\w+)\s*\([^)]*\)\s*(?:const|override|noexcept|final)?\s*\{?\s*$",
        r"^class\s+(\w+)",
        r"^struct\s+(\w+)",
        r"^namespace\s+(\w+)",
    ],
    "c": [r"^[\w\*\s]+\s+(\w+)\s*\([^)]*\)\s*\{?\s*$", r"^struct\s+(\w+)"],
    "cs": [
        r"^\s*(?:public|private|protected|internal|static|virtual|override|async)[\w\s<>\[\]]*\s+(\w+)\s*\(",
        r"^\s*(?:public|private|internal|sealed|abstract)?\s*class\s+(\w+)",
        r"^\s*interface\s+(\w+)",
        r"^\s*(?:public|private)?\s*(?:static)?\s*(?:readonly)?\s*(?:event)\s+\S+\s+(\w+)",
    ],
    "py": [r"^(?:async\s+)?def\s+(\w+)\s*\(", r"^class\s+(\w+)"],
    "java": [
        r"^\s*(?:public|private|protected|static|final|native|synchronized|abstract|transient)*\s+[\w<>\[\]]+\s+(\w+)\s*\(",
        r"^\s*(?:public|private|protected)?\s*(?:abstract|final)?\s*class\s+(\w+)",
        r"^\s*interface\s+(\w+)",
    ],
    "js": [_ARROW_OR_FUNCTION, r"^\s*class\s+(\w+)", r"^\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{"],
    "ts": [
        _ARROW_OR_FUNCTION,
        r"^\s*class\s+(\w+)",
        r"^\s*interface\s+(\w+)",
        r"^\s*(?:export\s+)?(?:async\s+)?(\w+)\s*\([^)]*\)",
    ],
}
SYMBOL_EXTENSIONS = {
    "cpp": ["cpp", "h", "cxx", "cc"], "c": ["c"], "cs": ["cs"], "py": ["py"], "java": ["java"],
    "js": ["js", "jsx"], "ts": ["ts", "tsx"],
}

# --- architecture facts (multi-line patterns over whole file texts) ---------
API_PATTERNS = [
    r"\bpublic\s+(?:static\s+)?(?:abstract\s+)?[\w<>\[\]]+\s+(\w+)\s*\(",
    r"^\s*def\s+([\w]+)\s*\(self",
    r"^\s*export\s+(?:default\s+)?(?:function|class|const)\s+(\w+)",
    r"^\s*module\.exports",
    r"\[HttpGet\]|\[HttpPost\]|\[HttpPut\]|\[HttpDelete\]|\[Route\(",
    r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)",
    r"app\.(get|post|put|delete|patch)\s*\(",
]
IMPORT_PATTERNS = [
    r"^#include\s+[<\"](.+?)[>\"]",
    r"^\s*import\s+(\S+)",
    r"^\s*from\s+(\S+)\s+import",
    r"^\s*using\s+([\w.]+)\s*;",
    r"require\s*\(\s*['\"](.+?)['\"]\s*\)",
    r"import\s+.*?\s+from\s+['\"](.+?)['\"]",
]
NEW_COMPONENT_PATTERNS = [
    r"^\+\s*(?:public\s+)?class\s+(\w+)",
    r"^\+\s*(?:export\s+)?class\s+(\w+)",
    r"^\+class\s+(\w+)",
    r"^\+\s*interface\s+(\w+)",
    r"^\+\s*(?:abstract\s+)?class\s+(\w+)",
    r"^class\s+(\w+)",
    r"^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)",
    r"^interface\s+(\w+)",
]
REMOVED_COMPONENT_PATTERNS = [
    r"^-\s*(?:public\s+)?class\s+(\w+)",
    r"^-\s*(?:export\s+)?class\s+(\w+)",
    r"^-class\s+(\w+)",
    r"^-\s*interface\s+(\w+)",
]
CONCURRENCY_PATTERNS = [
    (r"\bmutex\b|\block\b|\bsemaphore\b|\batomic\b", "i"),
    (r"\bthread\b|\bworker\b|\basync\b|\bawait\b|\bTask\b|\bFuture\b", ""),
    (r"\bstd::thread\b|\bpthread\b|\bQThread\b", ""),
    (r"\bCriticalSection\b|\bInterlockedExchange\b", ""),
]
MEMORY_PATTERNS = [
    (r"\bnew\s+\w+\[|\bdelete\s*\[\]", ""),
    (r"\bmalloc\b|\bfree\b|\bcalloc\b|\brealloc\b", ""),
    (r"\bshared_ptr\b|\bunique_ptr\b|\bweak_ptr\b", ""),
    (r"\bmemcpy\b|\bmemmove\b|\bmemset\b", ""),
]

# --- token estimate ---------------------------------------------------------
CHARS_PER_TOKEN_CODE = 3.5
CHARS_PER_TOKEN_PROSE = 4.0
USD_PER_1K_TOKENS = 0.005

# --- redaction --------------------------------------------------------------
KEPT_WORDS = """
if else elif for while do switch case default break continue return goto try catch finally throw
raise except with as yield async await
def class struct enum union namespace using import from include
public private protected static const constexpr final override virtual abstract sealed readonly
volatile extern inline friend template typename auto
void int long short char bool float double unsigned signed string var let function new delete
this self super null nullptr None true false True False and or not in is lambda
interface implements extends instanceof
pass global nonlocal del assert package module export sizeof typedef operator explicit mutable
noexcept thread_local
std System Console Math Object Array Promise vector map set pair list dict tuple
""".split()
KEPT_TYPES = """
bool int void char float double size_t uint8_t uint16_t uint32_t uint64_t int8_t int16_t int32_t
int64_t string vector map set list dict RequestContext Response Result Status
""".split()
PUBLIC_PREFIXES = """
Validate Check Verify Lock Unlock Get Set Create Delete Remove Add Update Record Log Encrypt Decrypt
Hash Sign Authenticate Initialize Shutdown Connect Disconnect Open Close Load Save Parse Format
Encode Decode
""".split()
REDACTION_MODES = ["full", "api-safe", "api-safe-comments", "signature"]
COLLAPSE_MARKER = "··· [{n} line(s) redacted] ···"

# --- control flow -----------------------------------------------------------
NON_SOURCE_LINES = [
    r"\brefers to\b",
    r"^\s*[\w.]+\.o\([^)]*\)",
    r"^\s*Execution Region\b",
    r"\b(Object|Grand|ELF Image|ROM|RAM)\s+Totals\b",
    r"^\s*Load Region\b",
    r"^\s*\*{3,}",
    r"^\s*={3,}",
    r"^\s*-{3,}",
    r"^\s*Section Cross References\b",
    r"^\s*(Code|Data|RO|RW|ZI)\s+Size\b",
]
NON_SOURCE_SHARE = 0.34
CONTROL_WORDS = """
if for while switch catch return sizeof else do try finally new delete typeof instanceof in of
function async await
""".split()
EVENT_PATTERNS = [
    (r"addEventListener\s*\(\s*[\"'](\w+)[\"']", "Listen"),
    (r"\.on\s*\(\s*[\"'](\w+)[\"']", "Listen"),
    (r"\bemit\s*\(\s*[\"'](\w+)[\"']", "Emit"),
    (r"\btrigger\s*\(\s*[\"'](\w+)[\"']", "Emit"),
    (r"\bsubscribe\s*\(\s*[\"'](\w+)[\"']", "Listen"),
    (r"\bdispatch\s*\(\s*(\w+)", "Emit"),
]
NON_SOURCE_SUFFIXES = """
.map .hex .bin .elf .o .obj .uvprojx .uvoptx .uvguix .axf .lib .a .dll .so .exe .log .txt .md .json
.xml
""".split()
MAX_DIAGRAM_NODES = 25
NAME_CHARS = 40
MAX_FLOW_FILES = 8

# --- snapshots and compare reports ------------------------------------------
TEXT_EXTENSIONS = """
c cpp cxx cc h hpp hxx cs py java js ts jsx tsx txt md json xml yaml yml cmake mk makefile bat sh ps1
cfg ini toml gitignore
""".split()
REPORT_STATUSES = ["different", "leftonly", "rightonly", "binarydiffer", "error"]
SNAPSHOT_CONTEXT = 5
