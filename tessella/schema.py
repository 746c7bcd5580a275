"""Stored tables as Spark schemas, and the constants that the operators share."""

from __future__ import annotations

# Stored tables, as DDL that Spark's readers and createDataFrame take.
WINGS = "id long, name string, description string, created_at timestamp"
ROOMS = "id long, wing_id long, name string, description string, created_at timestamp"
PAGES = "id long, room_id long, slug string, title string, source_path string, source_kind string, page_kind string, created_at timestamp, updated_at timestamp, metadata map<string,string>"
CHUNKS = "id long, page_id long, chunk_index int, chunk_text string, token_count int, embedding array<float>, terms array<string>, created_at timestamp"
ENTITIES = "id long, name string, entity_type string, metadata map<string,string>, created_at timestamp"
RELATIONS = "source_id long, target_id long, relation_type string, weight float, created_at timestamp"
ENTITY_CHUNKS = "entity_id long, chunk_id long, relevance float, created_at timestamp"
ENTITY_LEARNING = "entity_name string, entity_type string, consensus_score float, status string, confirmed_by array<string>, rejected_by array<string>, last_evaluated_at timestamp, eval_count int"
AGENTS = "agent_id string, name string, wing string, room string, created_at timestamp"
FACTS = "fact_id long, fact_text string, valid_from timestamp, valid_to timestamp, agent_id string, episode_type string, metadata map<string,string>"

# Ranks of ordered enumerations (unknown: 0).
INTELLIGENCE = {"low": 0, "medium": 1, "high": 2, "very_high": 3}
COST = {"free": 0, "low": 1, "medium": 2, "high": 3}
SPEED = {"batch": 0, "slow": 1, "medium": 2, "fast": 3}

# Votes of extraction modes, and of the ones that merging knows.
MODE_WEIGHTS = {"regex": 1.0, "hybrid-7b": 0.9, "hybrid-1.5b": 0.8, "7b": 0.7, "1.5b": 0.5, "gpt-4o-mini": 0.95}
MERGE_WEIGHTS = {"regex": 1.0, "hybrid-7b": 0.9, "hybrid-1.5b": 0.8, "7b": 0.7, "1.5b": 0.5}
DEFAULT_WEIGHT = 0.5

# Which entity of a group is kept first when groups are fused.
TYPE_PRIORITY = {"class": 0, "function": 1, "module": 2, "api": 3, "concept": 4}

# Chunking strategy by file suffix.
STRATEGIES = {
    "markdown": [".md", ".mdx", ".markdown"],
    "code": [".py", ".java", ".js", ".ts", ".vue", ".jsx", ".tsx", ".go", ".rs", ".rb", ".php", ".c", ".cpp", ".h", ".hpp", ".swift", ".kt", ".html", ".css", ".scss"],
    "sql": [".sql"],
    "config": [".yaml", ".yml", ".json", ".xml", ".toml"],
    "lines": [".cfg", ".ini", ".conf", ".log"],
}

# Words that are no names of code.
RESERVED = [
    "void", "int", "string", "boolean", "long", "double", "true", "false", "null", "this", "return", "if", "else", "for", "while", "class",
    "function", "import", "export", "default", "extend", "implements", "throws", "new", "type", "extends",
]
# Names that say nothing.
GENERIC = [
    "system", "data", "function", "code", "file", "text", "information", "content", "value", "method", "class", "object", "name", "type", "thing",
    "stuff", "part", "item", "path", "list", "array", "map", "set", "view", "module", "api", "concept", "entity", "service", "component", "config",
    "model", "utils", "helper", "util", "common", "base", "abstract",
]
# Entities that are pruned.
STOP_ENTITIES = [
    "data", "info", "information", "content", "text", "file", "code", "name", "type", "value", "key", "id", "list", "map", "set", "array", "object",
    "class", "method", "function", "field", "property", "result", "response", "request", "input", "output", "status", "config", "configuration",
    "setting", "option", "param", "parameter", "item", "tag", "label", "title", "desc", "description", "summary", "index", "node", "path", "url",
    "uri", "link", "ref", "reference", "system", "service", "module", "component", "util", "utils", "helper", "api", "rest", "soap", "json", "xml",
    "yaml", "yml", "sql", "string", "integer", "boolean", "long", "double", "float", "byte", "char", "short", "void", "exception", "throwable",
    "serialversionuid", "logger", "log", "autowired", "inject", "resource", "override", "deprecated", "suppresswarnings", "test", "before", "after",
    "setup", "teardown", "todo", "fixme", "hack", "xxx", "note",
]
# Types of fields that give no relation.
FIELD_TYPES = [
    "int", "long", "double", "float", "boolean", "string", "void", "list", "set", "map", "integer", "byte", "short", "char", "object",
]

# A name, and what stands for it.
SYNONYMS = {
    "kyc": ["kyc", "kycapplication", "kyc_application", "客户身份识别", "kyc认证"],
    "kycapplication": ["kycapplication", "kyc_application", "kyc", "kycapplicationservice"],
    "user": ["user", "用户", "userinfo", "user_info"],
    "auth": ["auth", "authentication", "认证", "授权"],
    "permission": ["permission", "权限", "permissions"],
    "role": ["role", "角色", "roles"],
    "order": ["order", "订单", "trade", "交易"],
    "position": ["position", "持仓", "positions"],
    "margin": ["margin", "保证金", "margins"],
    "settlement": ["settlement", "结算", "清算"],
    "config": ["config", "configuration", "配置", "cfg"],
    "service": ["service", "services"],
    "dao": ["dao", "repository", "repositories", "mapper"],
    "dto": ["dto", "vo", "request", "response", "command", "query"],
}
#: alias -> name; of names that share an alias the last one counts.
ALIASES = {alias: name for name, aliases in SYNONYMS.items() for alias in aliases}
# Parts of camel-case names that say nothing, and endings that a canonical name loses.
CAMEL_STOP = [
    "get", "set", "is", "has", "to", "of", "in", "on", "at", "by", "for", "with", "from", "data", "info", "base", "abstract", "utils", "util",
    "helper", "common", "core",
]
SUFFIXES = [
    "service", "impl", "dto", "vo", "dao", "mapper", "repository", "controller", "config", "utils", "request", "response", "command", "query",
    "entity", "model", "pojo", "po", "bo",
]

# File kinds of the content classifier.
CLASS_EXTENSIONS = {
    "code": [".java", ".py", ".vue", ".js", ".ts", ".jsx", ".tsx", ".go", ".rs", ".rb", ".php", ".kt", ".swift", ".c", ".cpp", ".h"],
    "docs": [".md", ".rst", ".txt", ".adoc", ".wiki"],
    "config": [".xml", ".yml", ".yaml", ".sql", ".properties", ".conf", ".gradle", ".toml", ".ini", ".cfg"],
    "log": [".log", ".out", ".err"],
    "skip": [
        ".lock", ".min.js", ".min.css", ".map", ".svg", ".png", ".jpg", ".gif", ".ico", ".woff", ".ttf", ".zip", ".tar", ".gz", ".jar", ".war", ".class", ".o",
        ".a", ".so", ".dll", ".dylib", ".pyc", ".pyo", ".pkl", ".pickle",
    ],
}
