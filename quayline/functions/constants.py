"""Values that outside systems agree on: file suffixes, field names, limits."""

# ---- fixed values: file suffixes per format (compared on the lower-cased key)
FORMAT_EXTENSIONS = {
    "json": (".json", ".json.gz", ".jsonl", ".jsonl.gz", ".ndjson", ".ndjson.gz"),
    "csv": (".csv", ".csv.gz"),
    "parquet": (".parquet", ".pq"),
}

# ---- fixed values: CDN real-time log fields in the order the service sends them
CDN_FIELDS = (
    "timestamp",
    "c-ip",
    "s-ip",
    "time-to-first-byte",
    "sc-status",
    "sc-bytes",
    "cs-method",
    "cs-protocol",
    "cs-host",
    "cs-uri-stem",
    "cs-bytes",
    "x-edge-location",
    "x-edge-request-id",
    "x-host-header",
    "time-taken",
    "cs-protocol-version",
    "c-ip-version",
    "cs-user-agent",
    "cs-referer",
    "cs-cookie",
    "cs-uri-query",
    "x-edge-response-result-type",
    "x-forwarded-for",
    "ssl-protocol",
    "ssl-cipher",
    "x-edge-result-type",
    "fle-encrypted-fields",
    "fle-status",
    "sc-content-type",
    "sc-content-len",
    "sc-range-start",
    "sc-range-end",
    "c-port",
    "x-edge-detailed-result-type",
    "c-country",
    "cs-accept-encoding",
    "cs-accept",
    "cache-behavior-path-pattern",
    "cs-headers",
    "cs-header-names",
    "cs-headers-count",
    "primary-distribution-id",
    "primary-distribution-dns-name",
    "origin-fbl",
    "origin-lbl",
    "asn",
    "cmcd-encoded-bitrate",
    "cmcd-buffer-length",
    "cmcd-buffer-starvation",
    "cmcd-content-id",
    "cmcd-object-duration",
    "cmcd-deadline",
    "cmcd-measured-throughput",
    "cmcd-next-object-request",
    "cmcd-next-range-request",
    "cmcd-object-type",
    "cmcd-playback-rate",
    "cmcd-requested-maximum-throughput",
    "cmcd-streaming-format",
    "cmcd-session-id",
    "cmcd-stream-type",
    "cmcd-startup",
    "cmcd-top-bitrate",
    "cmcd-version",
    "r-host",
    "sr-reason",
    "x-edge-mqcs",
    "distribution-tenant-id",
    "connection-id",
)

# ---- fixed values: fields logged when the caller names none
CDN_DEFAULT_FIELDS = (
    "timestamp", "c-ip", "time-to-first-byte", "sc-status", "sc-bytes",
    "cs-method", "cs-protocol", "cs-host", "cs-uri-stem", "cs-bytes",
    "x-edge-location", "time-taken", "cs-protocol-version", "cs-user-agent",
    "x-edge-response-result-type", "ssl-protocol", "x-edge-result-type",
    "c-port", "x-edge-detailed-result-type", "c-country",
)

# ---- fixed values: skip reasons of an object event, in the order they are checked
INVALID_EVENT = "invalid event"
PREFIX_MISMATCH = "prefix mismatch"
FORMAT_MISMATCH = "format mismatch"
PATTERN_MISMATCH = "pattern mismatch"

# ---- fixed values: what an object-created notification says about itself
OBJECT_EVENT_SOURCES = ("aws.s3",)
OBJECT_EVENT_DETAIL_TYPES = ("Object Created",)

# ---- fixed values: delivery endpoint paths and its error messages
DELIVERY_PATH = r"^/v1/([^/]+)/([^/]+)/tables/([^/?]+)"
DELIVERY_TRANSFORM = "firehose"
DELIVERY_ERRORS = {
    405: "method not allowed",
    404: "404 page not found",
    403: "invalid access key",
    400: "invalid JSON body",
    500: "base64 decode",
}
UNREADABLE_BODY = "failed to read body"

# ---- fixed values: backup modes, retention, buffer and sampling bounds
BACKUP_FAILED_ONLY = "FailedDataOnly"
BACKUP_ALL = "AllData"
BACKUP_RETENTION_DAYS = 30
BUFFER_MB = (1, 64, 5)  # least, most, default
BUFFER_SECONDS = (60, 900, 300)  # least, most, default
SAMPLING_PERCENT = (1, 100, 100)  # least, most, default

# ---- fixed values: request-log rules of the sample firewall
SCANNER_AGENTS = ("nikto", "sqlmap", "nmap", "dirbuster")
BLOCKED_COUNTRIES = ("KP", "IR", "CU", "SY")
RATE_LIMITS = (10000, 100)  # requests per window and address: wide, strict
RATE_WINDOW_SECONDS = 300

# ---- fixed values: characters with the Unicode White_Space property
# (Spark's plain trim() removes U+0020 only)
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
