"""Table layouts shared by sources, operators and sinks (DDL strings)."""

FILES = "repo_name STRING, path STRING, content STRING, read_error STRING"

# What an extractor produces for one file, before repo_name and path are attached.
FINDING_CORE = "STRUCT<name: STRING, type: STRING, category: STRING, properties: STRING>"
FINDING_CORE_ARRAY = f"ARRAY<{FINDING_CORE}>"

FINDING_COLUMNS = ["name", "type", "category", "path", "repo_name", "properties"]
FINDINGS = (
    "name STRING, type STRING, category STRING, path STRING, repo_name STRING, properties STRING"
)

EXTRACT_ERRORS = "repo_name STRING, path STRING, extractor STRING, message STRING"

PATTERNS = (
    "name STRING, type STRING, category STRING, file_names ARRAY<STRING>, "
    "path_patterns ARRAY<STRING>, file_extensions ARRAY<STRING>, "
    "content_patterns ARRAY<STRING>, properties MAP<STRING, STRING>"
)

REFS = "repo_name STRING, ref_name STRING, ref_kind STRING, author_when TIMESTAMP_NTZ"
TAGS = "repo_name STRING, tag_name STRING, tagger_when TIMESTAMP_NTZ, committer_when TIMESTAMP_NTZ"
COMMITS = (
    "repo_name STRING, hash STRING, author_email STRING, author_when TIMESTAMP_NTZ, "
    "committer_when TIMESTAMP_NTZ, tz_offset_minutes INT"
)
REPOS = "full_name STRING, clone_url STRING, batch BIGINT, payload STRING"

VULN_REPORT = (
    "repo_name STRING, Results ARRAY<STRUCT<Target: STRING, Class: STRING, Type: STRING, "
    "Vulnerabilities: ARRAY<STRUCT<VulnerabilityID: STRING, PkgName: STRING, "
    "InstalledVersion: STRING, FixedVersion: STRING, Severity: STRING, Title: STRING, "
    "Description: STRING>>>>"
)
