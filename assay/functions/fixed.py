"""Word lists and limits that results depend on."""

# fixed values
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "if", "in", "into", "is", "it", "of", "on", "or", "that", "the", "this", "to", "what", "when", "where", "which", "with")
SKIP_FOLDERS = (".git", ".venv", "venv", "__pycache__", "node_modules", ".next", "dist", "build", ".pytest_cache", ".mypy_cache")
TEXT_SUFFIXES = (".c", ".cc", ".cjs", ".cpp", ".cts", ".h", ".hpp", ".java", ".js", ".json", ".jsx", ".md", ".mjs", ".mts", ".py", ".rb", ".rst", ".sh", ".tcl", ".toml", ".ts", ".tsx", ".txt", ".yaml", ".yml")
CODE_SUFFIXES = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".rb", ".c", ".cc", ".cpp", ".h", ".hpp", ".mjs", ".cjs", ".mts", ".cts")
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".mts", ".cts")
MAX_FILE_BYTES = 256_000
GENERIC_PATH_WORDS = ("__tests__", "app", "apps", "build", "component", "components", "dist", "e2e", "frontend", "lib", "libs", "page", "pages", "pkg", "packages", "public", "route", "routes", "screen", "screens", "service", "services", "shared", "spec", "src", "test", "tests", "ui", "utils", "view", "views", "web")
FRONTEND_WORDS = ("api", "app", "component", "components", "e2e", "error", "index", "layout", "loading", "page", "pages", "route", "routes", "screen", "screens", "spec", "src", "test", "tests", "__tests__", "ui", "view", "views", "web")
GENERIC_STEMS = ("index", "layout", "loading", "error", "page", "route", "main", "__init__")
WARNING_TERMS = ("deprecated", "do not use", "unsupported", "archived", "legacy sentinel")
TOP_EVIDENCE, TOP_TWINS, FOCUS_PATHS = 5, 3, 2
ADMIT_COUNT, ADMIT_SCORE, ESCALATE_COUNT, ESCALATE_SCORE = 2, 0.25, 1, 0.12
WINDOW_BYTES, STRIDE_BYTES, HAZARD_PERCENTILE = 96, 48, 0.8
COVERAGE_MIN, SEMANTIC_MIN, PATTERN_MIN, HAZARD_FLOOR = 0.5, 0.08, 0.08, 0.75
NOTE_NO_EVIDENCE = "No directly supporting code or documentation was found."
NOTE_UNVERIFIED = "Retrieved evidence could not be verified against the truth-pack."
NOTE_GAP = "The proposed changed paths were not directly supported by the retrieved evidence."
NOTE_WARNING = "Top retrieved evidence was marked deprecated or explicitly unsafe."
NOTE_NO_TEST = "No supporting test evidence was found for the affected flow."
NOTE_NO_FRONTEND_TEST = "Downstream frontend tests appear impacted, but no supporting frontend test evidence was found."
NOTE_NO_RUNBOOK = "No runbook or operational handling evidence was found."
NOTE_NO_PRECEDENT = "No prior PR or incident precedent was found."
BREACH_FILES = "Blast radius files %d exceeded policy limit %d."
BREACH_HAZARD = "Hazard score %.2f exceeded policy limit %.2f."
BREACH_CONFIDENCE = "Confidence %.2f fell below policy minimum %.2f."
BREACH_TEST = "Policy requires supporting test evidence."
BREACH_RUNBOOK = "Policy requires runbook or operational evidence."
BREACH_PRECEDENT = "Policy requires prior precedent."
BREACH_NO_INCIDENT = "Policy requires prior incident precedent."
BREACH_INCIDENT = "Policy blocks changes that match prior incident precedent."
POLICIES = (
    # name, profile, most files, most hazard, least confidence, need test, runbook, precedent, incident precedent, block on incident
    ("strict", "default", 5, 0.45, 0.55, True, True, True, False, True),
    ("agile", "open_source", 25, 0.8, None, True, False, False, False, False),
)
POLICY_LABELS = {"need_test": "Test evidence required", "need_runbook": "Runbook evidence required", "need_precedent": "Precedent required", "need_incident": "Incident precedent required", "block_incident": "Incident match blocks rollout", "max_files": "Blast radius limit", "max_hazard": "Hazard threshold", "min_confidence": "Minimum confidence"}
FOCUS_IGNORE = ("act", "action", "behavior", "change", "code", "doc", "docs", "example", "examples", "fastapi", "implicated", "precedent", "pr", "prs", "runbook", "runbooks", "support", "supports", "test", "tests", "what")
SIGNATURE_IGNORE = ("applications", "behavior", "configuration", "documentation", "example", "examples", "flow", "generation", "handling", "helper", "lifecycle", "mount", "parameter", "reference", "response", "routing", "schema", "security", "sql", "support", "tutorial")
HEALING_PROMPT = ("\n\nThe previous attempt was blocked because: ", ". Write the missing test coverage or update the supported files, then retry.")
NO_GUIDANCE = "missing supporting evidence"
SIGNAL_LABELS = {"jira": "Jira", "slack": "Slack", "pagerduty": "PagerDuty", "incident": "Incident", "github": "GitHub PR"}
