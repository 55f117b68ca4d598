"""Explicit schemas of the tables the library reads and writes (every table leads with `repo`)."""

FILES = "repo string, path string, ext string, language string, size long, mtime timestamp, content string"
SYMBOLS = (
    "repo string, id long, name string, kind string, file string, line int, end_line int, "
    "signature string, return_type string, body_hash string, language string"
)
CALLS = (
    "repo string, id long, caller_id long, callee_name string, file string, line int, arguments string, kind string"
)
IMPORTS = "repo string, id long, file string, symbol_name string, source_module string, alias string"
COLUMNS = "repo string, id long, symbol_id long, table_name string, column_name string, operation string"
INDEX_FILES = "repo string, path string, mtime_ms long, language string"
NODES = (
    "repo string, id string, type string, name string, file_path string, line int, language string, "
    "framework string, metadata map<string,string>"
)
EDGES = "repo string, src string, dst string, type string, metadata map<string,string>"
ENRICHMENT = (
    "repo string, node_id string, purpose string, pattern string, domain string, risk string, summary string, "
    "semantic_edges array<struct<target:string,type:string,reason:string>>, enriched_at timestamp, depth string"
)
COMMITS = "repo string, hash string, author string, ts timestamp, subject string, file string"
MESSAGES = "session_id string, turn int, role string, text string, ts timestamp"

# The node and edge types a graph may hold.
NODE_TYPES = [
    "repo", "service", "module", "file", "class", "function", "endpoint", "table", "schema", "queue", "event", "config", "external",
]
EDGE_TYPES = [
    "imports", "calls", "reads", "writes", "publishes", "subscribes", "exposes", "consumes", "contains", "configures", "deploys-with", "depends-on",
]
