"""Which language a file is written in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codeatlas.functions.text import basename, extension

# Extension to language name in statistics.
EXTENSION_LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript (JSX)", ".js": "JavaScript", ".jsx": "JavaScript (JSX)",
    ".mjs": "JavaScript", ".cjs": "JavaScript", ".py": "Python", ".rb": "Ruby", ".go": "Go", ".rs": "Rust",
    ".java": "Java", ".kt": "Kotlin", ".swift": "Swift", ".c": "C", ".cpp": "C++", ".h": "C/C++ Header", ".cs": "C#",
    ".php": "PHP", ".vue": "Vue", ".svelte": "Svelte", ".astro": "Astro", ".html": "HTML", ".css": "CSS",
    ".scss": "SCSS", ".less": "Less", ".json": "JSON", ".yaml": "YAML", ".yml": "YAML", ".toml": "TOML", ".xml": "XML",
    ".md": "Markdown", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".fish": "Shell",
    ".dockerfile": "Dockerfile", ".tf": "Terraform", ".hcl": "HCL", ".proto": "Protobuf", ".graphql": "GraphQL",
    ".gql": "GraphQL",
}
# Extension and file name to the analyser that reads the file.
ANALYSER_EXTENSIONS = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".py": "python", ".java": "java", ".sql": "sql", ".cbl": "cobol", ".cob": "cobol", ".cpy": "cobol",
    ".yaml": "openapi", ".yml": "openapi",
}
ANALYSER_FILENAMES = {
    "Dockerfile": "docker", "docker-compose.yml": "docker", "docker-compose.yaml": "docker",
}


def _lookup(key: Column, values: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def language_of(path: Column | str) -> Column:
    """Language for extraction; a known file name wins over the extension, null when neither is known."""
    return F.coalesce(_lookup(basename(path), ANALYSER_FILENAMES), _lookup(extension(path), ANALYSER_EXTENSIONS))


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("language", language_of(path))


def statistics_language(path: Column | str) -> Column:
    return _lookup(extension(path), EXTENSION_LANGUAGES)
