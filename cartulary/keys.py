"""Key columns, closed domains and limits shared by all operators."""

# A snapshot of one database.
SNAPSHOT = ["catalog_id", "snapshot_id"]
# One relation of one snapshot.
RELATION = SNAPSHOT + ["relation_id"]

# Snapshot format and the name of the captured metadata set.
FORMAT = 2
COVERAGE = "pg-catalog-v1"

# Structural sections in report order.
SECTIONS = [
    "kind", "columns", "primaryKey", "uniques", "checks",
    "foreignKeys", "indexes", "view", "partitionKey", "enums",
]

# Paging, request and text limits (characters are code points).
PAGE_DEFAULT, PAGE_MAX = 50, 100
REQUEST_MAX, NEIGHBOR_MAX = 20, 20
FIELD_LIMIT, OVERVIEW_LIMIT, LONG_LIMIT = 500, 120, 8000

# Server codes.
KINDS = {"r": "table", "p": "partitioned_table", "v": "view", "m": "materialized_view"}
ACTIONS = {"a": "no action", "r": "restrict", "c": "cascade", "n": "set null", "d": "set default"}
MATCHES = {"s": "simple", "f": "full", "p": "partial"}
IDENTITIES = {"a": "always", "d": "by_default"}

# Name patterns that mark a column as sensitive, in list order.
SENSITIVE_PATTERNS = [
    "password", "passwd", "secret", "token", "api_key", "apikey", "ssn", "email",
    "phone", "mobile", "iban", "card_number", "cvv", "dob", "birth_date", "address",
    "ip_address", "tc_kimlik", "tckn", "kimlik_no", "vergi_no", "salary", "maas",
]
