"""Fixed values of the audit model: languages, signal patterns, rules, ranks, names and limits."""

from __future__ import annotations

# Fixed values. Extensions of each language.
EXTENSIONS = {
    "java": (".java", ".jsp", ".jspx"),
    "php": (".php", ".phtml", ".php3", ".php4", ".php5", ".inc"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "python": (".py",),
    "csharp": (".cs",),
    "go": (".go",),
}
# Fixed values. Directories that a workspace scan leaves out.
EXCLUDED_DIRS = (".git", ".svn", "node_modules", "vendor", "target", "build", "dist", "coverage", ".gradle", ".mvn", ".venv", "venv", "__pycache__", "bin", "obj", "storage", "cache", "tmp", "temp")
# Fixed values. Limits.
MAX_FILES, MAX_FILE_BYTES, MAX_EVIDENCE, MAX_STATUSES, MAX_IMPORTED_EVIDENCE, MAX_IMPORT_BYTES = 8000, 2 * 1024 * 1024, 500, 10_000, 1000, 10 * 1024 * 1024
RETENTION_DAYS = 30
DEBOUNCE_MS = 850

# Fixed values. Signal patterns: kind, label, regex, category (the kind where None), whether strings are kept for the test.
_JS = [
    ("source", "HTTP request data", r"\breq(?:uest)?\.(?:body|query|params|headers|cookies|files)\b|\b(?:searchParams|formData)\.(?:get|getAll)\s*\(", None, False),
    ("source", "Framework-bound request data", r"@(?:Body|Query|Param|Headers|Req|Request|UploadedFile)\s*\(", None, False),
    ("source", "Process or event input", r"\bprocess\.argv\b|\bevent\.(?:data|body|queryStringParameters|pathParameters)\b", None, False),
    ("sink", "SQL / persistence operation", r"\.(?:query|execute|raw|\$queryRaw|\$executeRaw)\s*\(", "database", False),
    ("sink", "Operating-system command", r"\b(?:exec|execSync|spawn|spawnSync|fork)\s*\(|\bchild_process\.", "command", False),
    ("sink", "Dynamic JavaScript execution", r"\b(?:eval|Function)\s*\(|setTimeout\s*\(\s*[^,]+\s*,", "expression", False),
    ("sink", "Filesystem operation", r"\bfs(?:\.promises)?\.(?:readFile|writeFile|appendFile|unlink|rename|copyFile|createReadStream|createWriteStream)\s*\(", "file", False),
    ("sink", "Outbound network request", r"\b(?:fetch|axios\.(?:get|post|put|patch|delete)|https?\.(?:get|request))\s*\(", "network", False),
    ("sink", "Redirect target", r"\b(?:res|response)\.redirect\s*\(", "redirect", False),
    ("sink", "HTML or response output", r"\.(?:innerHTML|outerHTML)\s*=|\b(?:res|response)\.(?:send|write|end)\s*\(", "output", False),
    ("auth", "Authentication context", r"\b(?:req\.user|request\.user|isAuthenticated|passport\.authenticate|verifyToken|jwt\.verify)\b", None, False),
    ("auth", "Authorization decision", r"\b(?:authorize|authorization|hasRole|hasPermission|can|ability\.can)\s*\(", None, False),
    ("sanitizer", "Schema or input validation", r"(?i)\b(?:validate|sanitize|escape|parse|safeParse)\s*\(|\b(?:joi|zod|yup|validator)\b", None, False),
    ("sanitizer", "HTML sanitization", r"\b(?:DOMPurify\.sanitize|sanitizeHtml|encodeURIComponent|escapeHtml)\s*\(", None, False),
    ("sanitizer", "Canonical path check", r"\bpath\.(?:normalize|resolve|basename)\s*\(", None, False),
    ("sanitizer", "Parameterized SQL", r"""\.(?:query|execute)\s*\(\s*["'`][\s\S]*?(?:\?|\$\d+)""", None, True),
]
PATTERNS = {
    "java": [
        ("source", "HTTP parameter", r"(?:getParameter|getHeader|getCookies|getQueryString|getInputStream|getReader|getPathInfo|getRequestURI)\s*\(", None, False),
        ("source", "Framework-bound request data", r"@(?:RequestParam|PathVariable|RequestBody|CookieValue|RequestHeader|ModelAttribute)\b", None, False),
        ("sink", "SQL / persistence operation", r"\.(?:executeQuery|executeUpdate|execute|createNativeQuery|createQuery)\s*\(", "database", False),
        ("sink", "Operating-system command", r"(?:Runtime\.getRuntime\(\)\.exec|new\s+ProcessBuilder)\s*\(", "command", False),
        ("sink", "Filesystem operation", r"(?:new\s+File|Paths\.get|Path\.of|Files\.(?:read|write|delete|copy|move|newInputStream|newOutputStream))\s*\(", "file", False),
        ("sink", "Outbound network request", r"(?:new\s+(?:URL|URI)|URI\.create|\.getForObject|\.getForEntity|WebClient\.create|HttpRequest\.newBuilder)\s*\(", "network", False),
        ("sink", "Native deserialization", r"\.readObject\s*\(", "deserialization", False),
        ("sink", "Dynamic expression", r"\.parseExpression\s*\(", "expression", False),
        ("sink", "Redirect target", r"\.sendRedirect\s*\(", "redirect", False),
        ("sink", "Directory lookup", r"\.(?:lookup|search)\s*\(", "directory", False),
        ("auth", "Authorization annotation", r"@(?:PreAuthorize|PostAuthorize|Secured|RolesAllowed|DenyAll|PermitAll)\b", None, False),
        ("auth", "Security decision", r"(?:hasRole|hasAuthority|checkPermission|isAuthenticated|SecurityContextHolder|AccessDecisionManager)\s*\(", None, False),
        ("sanitizer", "Parameterized statement", r"(?:PreparedStatement|prepareStatement|\.set(?:String|Int|Long|Object)\s*\()", None, False),
        ("sanitizer", "Validation constraint", r"@(?:Valid|Validated|Pattern|Size|Min|Max|NotNull)\b", None, False),
        ("sanitizer", "Canonical path check", r"(?:normalize|toRealPath|getCanonicalPath)\s*\(", None, False),
        ("sanitizer", "Output encoding", r"(?:Encode\.forHtml|HtmlUtils\.htmlEscape|StringEscapeUtils\.escapeHtml)\s*\(", None, False),
    ],
    "php": [
        ("source", "HTTP request data", r"\$_(?:GET|POST|REQUEST|COOKIE|FILES|SERVER)\b", None, False),
        ("source", "Raw request body", r"php://input", None, False),
        ("sink", "SQL / persistence operation", r"(?:mysqli_query\s*\(|->(?:query|exec)\s*\()", "database", False),
        ("sink", "Operating-system command", r"\b(?:system|exec|shell_exec|passthru|popen|proc_open)\s*\(", "command", False),
        ("sink", "Dynamic PHP execution", r"\b(?:eval|assert)\s*\(", "expression", False),
        ("sink", "Filesystem operation", r"\b(?:include|include_once|require|require_once|file_get_contents|readfile|fopen|unlink|copy|rename|move_uploaded_file)\s*\(?", "file", False),
        ("sink", "Outbound network request", r"(?:curl_init\s*\(\s*(?!\))\S|curl_setopt\s*\([^,]+,\s*CURLOPT_URL\s*,)", "network", False),
        ("sink", "Object deserialization", r"\bunserialize\s*\(", "deserialization", False),
        ("sink", "HTTP response output", r"\b(?:echo|print)\b", "output", False),
        ("sink", "HTTP response header", r"\bheader\s*\(", "redirect", False),
        ("auth", "Authentication check", r"(?:Auth::(?:check|user|guard)|auth\(\)->|is_user_logged_in|wp_verify_nonce)\s*\(?", None, False),
        ("auth", "Authorization decision", r"""(?:Gate::|->middleware\s*\(\s*["']auth|current_user_can|authorize\s*\(|->can\s*\()""", None, False),
        ("sanitizer", "Prepared query", r"(?:->prepare\s*\(|mysqli_prepare\s*\(|->bindParam|->bindValue)", None, False),
        ("sanitizer", "Validated input", r"(?:filter_input|filter_var|->validate\s*\(|Validator::make)\s*\(", None, False),
        ("sanitizer", "Output encoding", r"\b(?:htmlspecialchars|htmlentities|esc_html|e)\s*\(", None, False),
        ("sanitizer", "Shell argument escaping", r"\b(?:escapeshellarg|escapeshellcmd)\s*\(", None, False),
        ("sanitizer", "Canonical path check", r"\b(?:realpath|basename)\s*\(", None, False),
    ],
    "javascript": _JS,
    "typescript": _JS,
    "python": [
        ("source", "HTTP request data", r"\brequest\.(?:args|form|values|json|data|files|cookies|headers|GET|POST|body)\b", None, False),
        ("source", "Framework-bound request data", r"\b(?:Query|Path|Body|Form|Header|Cookie)\s*\(", None, False),
        ("source", "Process or console input", r"\b(?:sys\.argv|os\.environ|getenv\s*\(|input\s*\()", None, False),
        ("sink", "SQL / persistence operation", r"\.(?:execute|executemany|raw)\s*\(", "database", False),
        ("sink", "Operating-system command", r"\b(?:os\.(?:system|popen)|subprocess\.(?:run|Popen|call|check_output|check_call))\s*\(", "command", False),
        ("sink", "Dynamic Python execution", r"\b(?:eval|exec|compile)\s*\(", "expression", False),
        ("sink", "Filesystem operation", r"\b(?:open|Path)\s*\(|\.(?:read_text|write_text|read_bytes|write_bytes|unlink|rename)\s*\(", "file", False),
        ("sink", "Outbound network request", r"\b(?:requests|httpx)\.(?:get|post|put|patch|delete|request)\s*\(|\burllib\.request\.urlopen\s*\(|\b(?:driver|browser|page)\.(?:get|goto|navigate)\s*\(", "network", False),
        ("sink", "Object deserialization", r"\b(?:pickle|dill)\.loads?\s*\(|\byaml\.(?:load|unsafe_load)\s*\(", "deserialization", False),
        ("sink", "Redirect target", r"\bredirect\s*\(", "redirect", False),
        ("auth", "Authentication decorator", r"@(?:login_required|permission_required|user_passes_test|requires_auth)\b", None, False),
        ("auth", "Authentication context", r"\b(?:current_user|request\.user|is_authenticated|has_perm|check_permission)\b", None, False),
        ("sanitizer", "Schema or form validation", r"\.(?:is_valid|validate|model_validate)\s*\(|\b(?:BaseModel|Serializer|Form)\b", None, False),
        ("sanitizer", "Parameterized SQL", r"""(?i)\.(?:execute|executemany)\s*\(\s*(?:[rub]{0,2})?["'][^"'\r\n]*(?:\?|%s|%\([^)]+\)s|:[A-Za-z_]\w*)[^"'\r\n]*["']\s*,""", None, True),
        ("sanitizer", "Output sanitization", r"\b(?:bleach\.clean|html\.escape|markupsafe\.escape)\s*\(", None, False),
        ("sanitizer", "Safe filename or canonical path", r"\b(?:secure_filename|resolve|normpath|basename)\s*\(", None, False),
    ],
    "csharp": [
        ("source", "HTTP request data", r"\bRequest\.(?:Query|Form|Headers|Cookies|Body|Path)\b", None, False),
        ("source", "Framework-bound request data", r"\[(?:FromBody|FromQuery|FromRoute|FromForm|FromHeader)\b", None, False),
        ("sink", "SQL / persistence operation", r"\b(?:SqlCommand|FromSqlRaw|ExecuteSqlRaw)\b|\.(?:ExecuteReader|ExecuteScalar|ExecuteNonQuery)\s*\(", "database", False),
        ("sink", "Operating-system command", r"\b(?:Process\.Start|new\s+ProcessStartInfo)\b", "command", False),
        ("sink", "Filesystem operation", r"\b(?:File|Directory)\.(?:Read|Write|Delete|Move|Copy|Open|Create)|\bPath\.Combine\s*\(", "file", False),
        ("sink", "Outbound network request", r"\bHttpClient\b|\.(?:GetAsync|PostAsync|SendAsync)\s*\(", "network", False),
        ("sink", "Object deserialization", r"\b(?:BinaryFormatter|LosFormatter|NetDataContractSerializer)\b|\.Deserialize\s*\(", "deserialization", False),
        ("sink", "Redirect target", r"\b(?:Redirect|RedirectToAction|Response\.Redirect)\s*\(", "redirect", False),
        ("auth", "Authorization attribute", r"\[(?:Authorize|AllowAnonymous)\b", None, False),
        ("auth", "Authorization decision", r"\b(?:User\.Identity|User\.IsInRole|AuthorizeAsync|HasClaim|CheckAccess)\b", None, False),
        ("sanitizer", "Model validation", r"\bModelState\.IsValid\b|\[(?:Required|RegularExpression|Range|StringLength)\b", None, False),
        ("sanitizer", "Output encoding", r"\b(?:HtmlEncoder\.Default\.Encode|WebUtility\.HtmlEncode|HttpUtility\.HtmlEncode)\s*\(", None, False),
        ("sanitizer", "Canonical path check", r"\bPath\.GetFullPath\s*\(", None, False),
    ],
    "go": [
        ("source", "HTTP request data", r"\br\.(?:FormValue|PostFormValue)\s*\(|\br\.URL\.Query\s*\(|\br\.Header\.Get\s*\(|json\.NewDecoder\s*\(\s*r\.Body", None, False),
        ("source", "Framework request parameter", r"\b(?:c|ctx)\.(?:Param|Query|PostForm|GetHeader|Bind|ShouldBind)\s*\(", None, False),
        ("source", "Process input", r"\bos\.(?:Args|Getenv)\b", None, False),
        ("sink", "SQL / persistence operation", r"\b(?:db|tx)\.(?:Query|QueryRow|Exec|Prepare)(?:Context)?\s*\(", "database", False),
        ("sink", "Operating-system command", r"\bexec\.Command(?:Context)?\s*\(", "command", False),
        ("sink", "Filesystem operation", r"\bos\.(?:Open|OpenFile|ReadFile|WriteFile|Remove|Rename|Create)\s*\(", "file", False),
        ("sink", "Outbound network request", r"\bhttp\.(?:Get|Post|NewRequest)\s*\(|\bclient\.Do\s*\(", "network", False),
        ("sink", "Template trust bypass", r"\btemplate\.(?:HTML|JS|URL)\s*\(", "output", False),
        ("sink", "Native deserialization", r"\b(?:gob|xml)\.NewDecoder\b|\.Decode\s*\(", "deserialization", False),
        ("auth", "Authentication or claims context", r"(?i)\b(?:jwt|claims|session|authenticated|currentUser)\b", None, False),
        ("auth", "Authorization decision", r"\b(?:authorize|hasRole|hasPermission|CanAccess)\s*\(", None, False),
        ("sanitizer", "Typed input conversion", r"\bstrconv\.(?:Atoi|ParseInt|ParseUint|ParseBool)\s*\(", None, False),
        ("sanitizer", "Path canonicalization", r"\bfilepath\.(?:Clean|Abs|Base)\s*\(", None, False),
        ("sanitizer", "Output encoding", r"\bhtml\.EscapeString\s*\(", None, False),
    ],
}
# Fixed values. Names that begin a statement rather than a call, and further names that are no variables.
CALL_KEYWORDS = frozenset("if for while switch catch with return throw new function def func class interface typeof sizeof isset empty echo print include require match select go defer".split())
OTHER_KEYWORDS = CALL_KEYWORDS | frozenset("const let var final public private protected internal static async await export default true false null nil None self this void string int long bool boolean class struct package import from as in else elif".split())
# Fixed values. Objects that answer a request and are never input.
RESPONSE_OBJECTS = ("res", "response", "reply", "w", "next", "done")
# Fixed values. Sink kinds and review ranks of sink categories.
SINK_KINDS = {"database": "SQL_QUERY", "command": "COMMAND_EXEC", "expression": "DYNAMIC_EXEC", "file": "FILE_ACCESS", "network": "HTTP_REQUEST", "redirect": "REDIRECT", "output": "RESPONSE_OUTPUT", "deserialization": "DESERIALIZATION", "directory": "DIRECTORY_LOOKUP"}
SINK_RANKS = {"command": 6, "expression": 6, "deserialization": 6, "database": 5, "file": 5, "network": 5, "redirect": 4, "output": 4, "directory": 3}
EVENT_ORDER = {"source": 0, "assignment": 1, "control": 2, "branch": 3, "call": 4, "sink": 5, "return": 6}
# Fixed values. Guard capabilities and the words that show them.
GUARDS = [
    ("SQL_PARAMETERIZATION", r"(?i)prepared|parameterized|bindParam|bindValue|prepareStatement"),
    ("SHELL_ESCAPE", r"(?i)shell argument|escapeshellarg|escapeshellcmd"),
    ("PATH_CONFINEMENT", r"(?i)canonical|realpath|normalize|safe filename|GetFullPath|filepath\.(?:Clean|Abs|Base)"),
    ("OUTPUT_ENCODING", r"(?i)output encoding|HTML sanit|htmlspecialchars|htmlentities|escapeHtml|EscapeString|Encode\.forHtml"),
    ("VALIDATE_SCHEME", r"(?i)scheme|protocol"),
    ("BLOCK_PRIVATE_IP", r"(?i)private (?:IP|network)|loopback|link-local|127\.0\.0\.1|169\.254"),
    ("VALIDATE_IP", r"(?i)validate.?ip|FILTER_VALIDATE_IP|ipaddress\.ip_address"),
    ("URL_POLICY", r"(?i)URL policy|allowed host|allowlist|hostname"),
]
SOURCE_WORDS = [
    ("HTTP_INPUT", r"(?i)HTTP|request|Framework-bound|Cookie|Header|route|query|form"),
    ("PROCESS_INPUT", r"(?i)argv|console|process|event input|environment|Getenv"),
    ("FILE_UPLOAD", r"(?i)upload|files?"),
]
AUTHENTICATION_WORDS = r"(?i)authentication|identity|session|current.?user|claims"
EXTERNAL_SOURCES = ("HTTP_INPUT", "PROCESS_INPUT", "FILE_UPLOAD", "EXTERNAL_INPUT")
# Fixed values. Rules: id, title, sink kinds, recommended guards, guards that suppress, severity, impact, CWE.
RULES = [
    ("potential-ssrf", "Potential server-side request forgery", ["HTTP_REQUEST"], ["VALIDATE_SCHEME", "BLOCK_PRIVATE_IP", "URL_POLICY"], [], "high", "Server-side network access", "CWE-918"),
    ("potential-command-injection", "Potential command injection", ["COMMAND_EXEC"], ["SHELL_ESCAPE"], [], "critical", "Operating-system command execution", "CWE-78"),
    ("potential-sql-injection", "Potential SQL injection", ["SQL_QUERY"], ["SQL_PARAMETERIZATION"], ["SQL_PARAMETERIZATION"], "high", "Database query execution", "CWE-89"),
    ("potential-path-traversal", "Potential path traversal", ["FILE_ACCESS"], ["PATH_CONFINEMENT"], [], "high", "Filesystem access", "CWE-22"),
    ("potential-open-redirect", "Potential untrusted redirect", ["REDIRECT"], ["URL_POLICY"], [], "medium", "Browser navigation", "CWE-601"),
    ("potential-unsafe-output", "Potential unsafe response output", ["RESPONSE_OUTPUT"], ["OUTPUT_ENCODING"], [], "medium", "Untrusted response content", "CWE-79"),
    ("potential-unsafe-deserialization", "Potential unsafe deserialization", ["DESERIALIZATION"], ["INPUT_VALIDATION"], [], "critical", "Object construction from untrusted data", "CWE-502"),
    ("potential-dynamic-execution", "Potential dynamic code execution", ["DYNAMIC_EXEC"], ["INPUT_VALIDATION"], [], "critical", "Dynamic expression or code execution", "CWE-95"),
]
SEVERITIES = ("critical", "high", "medium", "low", "info")
SENSITIVE_NAMES = "(?i)(?:auth|login|admin|upload|download|payment|billing|token|secret|config|account|user|permission|session|webhook|callback)"
STATUSES = ("unreviewed", "in_review", "reviewed", "blocked")
EVIDENCE_TYPES = ("Source", "Sink", "Authorization", "Validation", "Observation")
MODEL_SETTINGS = ("flowMaxDepth", "flowMaxPaths")
# Fixed values. Labels.
STATUS_LABELS = {"unreviewed": "Not reviewed", "in_review": "In review", "reviewed": "Reviewed", "blocked": "Needs context"}
ROLE_LABELS = {"input": "External input", "parameter": "Parameter", "assignment": "Assignment", "condition": "Control check", "validation": "Validation", "security-decision": "Security decision", "sensitive-use": "Sensitive use", "reference": "Reference"}
CONFIDENCE_LABELS = {"high": "High match", "medium": "Medium match", "review": "Check call target"}

#: Function headers, name and parameters as groups.
_JAVA = r"^\s*(?:(?:public|protected|private)\s+)(?:static\s+)?(?:final\s+)?(?:synchronized\s+)?[\w<>\[\],.?]+\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"
_PHP = r"(?i)^\s*(?:(?:public|protected|private|static|final|abstract)\s+)*function\s+&?\s*([A-Za-z_]\w*)\s*\(([^)]*)\)"
_JS_DECLARED = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$][\w$]*)\s*\(([^)]*)\)"
_JS_ARROW = r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|([A-Za-z_$][\w$]*))\s*=>"
_JS_INLINE = r"""\(\s*(?:"[^"]*"|'[^']*'|`[^`]*`|[^,()]+)\s*,\s*(?:async\s+)?(?:function\s+([A-Za-z_$][\w$]*)|function)?\s*\(([^)]*)\)\s*(?:=>|\{)"""
_JS_METHOD = r"^\s*(?:(?:public|private|protected|static|async|readonly|override)\s+)*([A-Za-z_$][\w$]*)\s*\((.*)\)\s*(?::[^={]+)?\s*\{"
_PYTHON = r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)\s*\(([^)]*)\)\s*(?:->[^:]+)?\s*:"
_CSHARP = r"^\s*(?:(?:public|private|protected|internal|static|async|virtual|override|sealed|new|partial|extern|unsafe)\s+)+(?:[\w<>,.?\[\]]+\s+)([A-Za-z_]\w*)\s*\(([^)]*)\)"
_GO = r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*\(([^)]*)\)"
#: The header forms of each language, in order of preference.
HEADERS = {"java": [_JAVA], "php": [_PHP], "javascript": [_JS_DECLARED, _JS_ARROW, _JS_INLINE, _JS_METHOD], "typescript": [_JS_DECLARED, _JS_ARROW, _JS_INLINE, _JS_METHOD], "python": [_PYTHON], "csharp": [_CSHARP], "go": [_GO]}

#: Fixed value: parameter types of Go request handlers.
GO_HANDLER = r"\b(?:http\.ResponseWriter|\*http\.Request|\*gin\.Context|echo\.Context)\b"

#: How routes are declared, by the framework's annotations, attributes, decorators and calls.
QUOTED_ROUTE = r"""["']([^"']+)["']"""
SPRING_MAPPING = r"@(GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping|RequestMapping)\s*(?:\(([^)]*)\))?"
SPRING_METHOD = r"RequestMethod\.(GET|POST|PUT|DELETE|PATCH)"
JAX_METHOD = r"@(GET|POST|PUT|DELETE|PATCH)\b"
JAX_PATH = r"""@Path\s*\(\s*["']([^"']+)["']"""
SERVLET_METHOD = r"^do(Get|Post|Put|Delete|Patch)$"
NEST_ROUTE = r"""(?i)@(Get|Post|Put|Delete|Patch|Options|All)\s*\(\s*["']?([^"')\s]*)"""
EXPORTED_METHOD = "^(GET|POST|PUT|DELETE|PATCH|OPTIONS)$"
EXPORT = r"\bexport\b"
PYTHON_ROUTE = r"""(?i)@(?:app|router|blueprint|bp)\.(get|post|put|delete|patch|options|route)\s*\(\s*["']([^"']+)["']([^)]*)"""
PYTHON_METHOD = r"""(?i)["'](GET|POST|PUT|DELETE|PATCH|OPTIONS)["']"""
PYTHON_REQUEST = r"\brequest\b"
CSHARP_HTTP = r"""(?i)\[Http(Get|Post|Put|Delete|Patch|Options)(?:\s*\(\s*["']([^"']*)["'])?"""
CSHARP_ROUTE = r"""(?i)\[Route\s*\(\s*["']([^"']+)["']"""
PHP_ROUTE = r"""(?i)(?:Route::|\$app->)(get|post|put|delete|patch|any)\s*\(\s*["']([^"']+)["']"""
SCRIPT_ROUTE = r"""(?i)\b(?:app|router|server|fastify)\.(get|post|put|delete|patch|options|all|use)\s*\(\s*["'`]([^"'`]+)["'`]"""
GO_HANDLE = r"""\b(?:http\.)?HandleFunc\s*\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_]\w*)"""
GO_ROUTER = r"""\b\w+\.(GET|POST|PUT|DELETE|PATCH|OPTIONS|Any|HandleFunc)\s*\(\s*["']([^"']+)["']\s*,\s*([A-Za-z_]\w*)"""
GO_METHODS = r"""(?i)\.Methods\s*\(\s*["'](GET|POST|PUT|DELETE|PATCH|OPTIONS)"""
