"""The phrases and weights that conversation scoring counts."""

LANGUAGE_TAGS = {
    "rust": ("cargo", "rustc", "trait", "impl", "fn", "let mut", "match", "Result", "Option"),
    "python": ("def", "import", "class", "self", "pip", "python", "django", "flask", "pandas"),
    "javascript": ("function", "const", "let", "var", "npm", "node", "react", "vue", "angular"),
    "go": ("func", "package", "import", "go mod", "goroutine", "channel", "interface"),
    "java": ("public class", "private", "static", "void", "import java", "maven", "gradle"),
}
TOPIC_TAGS = {
    "debugging": ("error", "bug", "fix", "debug", "issue", "problem", "crash"),
    "performance": ("slow", "fast", "optimize", "performance", "speed", "memory", "cpu"),
    "testing": ("test", "unit test", "integration", "mock", "assert", "spec"),
    "deployment": ("deploy", "production", "server", "docker", "kubernetes", "ci/cd"),
    "database": ("sql", "database", "query", "table", "index", "migration"),
    "api": ("api", "rest", "graphql", "endpoint", "request", "response"),
    "frontend": ("ui", "frontend", "css", "html", "component", "styling"),
    "backend": ("backend", "server", "service", "microservice", "architecture"),
}
TITLE_TAGS = {
    "question": ("how", "what", "why", "when", "where", "?"),
    "help": ("help", "assist", "support", "stuck"),
    "error": ("error", "fail", "broken", "issue", "problem"),
    "feature": ("add", "implement", "create", "build", "new"),
    "review": ("review", "check", "look", "feedback"),
}
LANGUAGE_WEIGHT, TOPIC_WEIGHT, TITLE_WEIGHT, PROJECT_WEIGHT = 0.8, 0.6, 0.5, 0.6

MILESTONES = ("breakthrough", "solved", "working", "success", "completed", "finished", "achieved", "milestone", "progress", "accomplished")
SUCCESSES = ("tests pass", "compilation successful", "no errors", "works correctly", "as expected", "perfect", "excellent", "great job", "well done")
RISKS = ("experimental", "risky", "might break", "not sure", "dangerous", "careful", "backup", "save state", "before we")
COMPLETIONS = ("done", "complete", "finished", "ready", "deployed", "shipped", "released", "final")
CHECKPOINT_WEIGHTS = ((MILESTONES, 0.3), (SUCCESSES, 0.4), (RISKS, 0.3), (COMPLETIONS, 0.4))
PHASES = (
    ("Completion", ("done", "complete", "finished")),
    ("Testing", ("test", "verify", "validate")),
    ("Debugging", ("debug", "error", "fix")),
    ("Implementation", ("implement", "code", "build")),
    ("Design", ("design", "plan", "architecture")),
    ("Research", ("research", "investigate", "explore")),
    ("Documentation", ("document", "readme", "comment")),
)
PHASE_BONUS = {"Implementation": 0.2, "Testing": 0.3, "Completion": 0.4, "Debugging": 0.1}

BRANCHES = ("alternative", "different approach", "another way", "try something else", "what if", "maybe we could", "alternatively", "or we could", "let's try", "experiment")
UNCERTAINTIES = ("not sure", "uncertain", "maybe", "perhaps", "might work", "could try", "not confident", "unsure")
ERRORS = ("error", "failed", "doesn't work", "not working", "issue", "problem", "bug", "exception")
BRANCH_WEIGHTS = ((UNCERTAINTIES, 0.3), (ERRORS, 0.4), (BRANCHES, 0.2))
STATES = (
    ("ErrorState", ("error", "failed", "issue")),
    ("OptionEvaluation", ("option", "choice", "alternative")),
    ("Implementation", ("implement", "code", "build")),
    ("Testing", ("test", "verify", "check")),
    ("Completion", ("done", "complete", "finished")),
)
STATE_BONUS = {"ErrorState": 0.3, "OptionEvaluation": 0.2, "ProblemExploration": 0.1}
REASON_BONUS = {"ErrorRecovery": 0.2, "UserRequested": 0.3, "AlternativeApproach": 0.1, "ExperimentalApproach": -0.1}

# Tag rules: name, tag, confidence, priority, kind, arguments, least.
TAG_RULES = (
    ("rust_keywords", "rust", 0.8, 200, "keyword", ("cargo", "rustc", "trait", "impl"), None),
    ("python_keywords", "python", 0.8, 200, "keyword", ("def ", "import ", "python", "pip"), None),
    ("javascript_keywords", "javascript", 0.8, 200, "keyword", ("function", "const ", "npm", "node"), None),
    ("rust_project", "rust", 0.9, 300, "project", ("rust",), None),
    ("python_project", "python", 0.9, 300, "project", ("python",), None),
    ("error_debugging", "debugging", 0.7, 150, "keyword", ("error", "bug", "debug", "fix"), None),
    ("performance_optimization", "performance", 0.7, 150, "keyword", ("slow", "optimize", "performance", "speed"), None),
    ("question_title", "question", 0.6, 100, "title", ("how", "what", "why", "?"), None),
    ("rust_files", "rust", 0.6, 120, "extension", ("rs", "toml"), None),
    ("python_files", "python", 0.6, 120, "extension", ("py", "pyx", "pyi"), None),
    ("long_conversation", "long-conversation", 0.5, 50, "messages", (), 20),
    ("branched_conversation", "branched", 0.6, 80, "branches", (), 1),
    ("help_request", "help", 0.6, 110, "keyword", ("help", "stuck", "assist", "support"), None),
)

THEMES = (
    ("Machine Learning", 3, ("machine learning", "ml", "neural network", "neural", "model training", "training", "deep learning", "ai", "artificial intelligence", "algorithm")),
    ("Error Resolution", 2, ("error", "debug", "fix")),
    ("API Development", 2, ("api", "endpoint")),
    ("Database Queries", 2, ("database", "sql")),
    ("Testing & QA", 2, ("test", "testing")),
    ("Deployment", 2, ("deploy", "deployment")),
    ("Performance", 2, ("performance", "optimization")),
    ("Security", 2, ("security", "auth")),
    ("Help & Support", 1, ("help", "assist")),
    ("Code Review", 1, ("review", "feedback")),
    ("Learning", 1, ("learn", "tutorial")),
)
PROJECT_TYPES = (
    ("rust", r"rust|cargo|\.rs$"),
    ("python", r"python|py|\.py$"),
    ("javascript", r"javascript|js|node|\.js$|\.jsx$"),
    ("typescript", r"typescript|ts|\.ts$|\.tsx$"),
    ("go", r"go|golang|\.go$"),
    ("ruby", r"ruby|rb|\.rb$"),
    ("markdown", r"markdown|md|\.md$"),
    ("yaml", r"yaml|yml|\.yaml$|\.yml$"),
    ("html", r"html|\.html$"),
)
