"""The rule catalog: built-in credential rules, custom rules, and their Spark form."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakframe.functions.text import expand_whitespace
from leakframe.severity import parse_severity

RULE_GROUPS = ("aws", "jwt", "github", "generic")
CHECKED_TOGETHER = 250  # patterns compiled by one query

CATALOG_SCHEMA = (
    "ordinal INT, rule_id STRING, rule_group STRING, description STRING, "
    "severity STRING, pattern STRING, group_idx INT, keywords ARRAY<STRING>"
)


@dataclass(frozen=True)
class Rule:
    """One pattern rule.

    ``pattern`` is a Java regular expression in which ``\\s`` means Unicode
    white space; the reported value is group 1, or the whole match when the
    pattern has no group. ``keywords`` are lower case and decide whether the
    pattern is tried on a line at all; with none it always is. ``shape`` names
    the line gate that every match of the rule passes (see ``operators.gate``);
    rules without one are gated by their keywords. ``dead_end`` matches text in
    which the pattern cannot match; it is tried second and stepped over, so
    that a long line is not searched again from every start inside it.
    """

    rule_id: str
    group: str
    severity: str
    description: str
    pattern: str
    keywords: tuple[str, ...] = ()
    ignore_case: bool = False
    shape: str | None = None
    dead_end: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "severity", parse_severity(self.severity))
        object.__setattr__(self, "keywords", tuple(self.keywords))

    @property
    def java_pattern(self) -> str:
        # (?d): only \n ends a line for ^ and $; (?iu): Unicode case folding.
        flags = "(?diu)" if self.ignore_case else "(?d)"
        # A dead end captures nothing, and empty values are dropped.
        tail = f"|{self.dead_end}" if self.dead_end else ""
        return flags + expand_whitespace(self.pattern + tail)

    @property
    def group_idx(self) -> int:
        return 1 if count_groups(self.pattern) else 0


def count_groups(pattern: str) -> int:
    """Number of capturing groups in a Java pattern."""
    groups, i, in_class = 0, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif ch == "[":
            in_class += 1
        elif ch == "]" and in_class:
            in_class -= 1
        elif ch == "(" and not in_class:
            rest = pattern[i + 1 : i + 4]
            named = rest.startswith("?<") and rest[2:3] not in ("=", "!")
            if not rest.startswith("?") or named:
                groups += 1
        i += 1
    return groups


# Rule ids, groups, severities, descriptions, patterns, keywords
# and their order. `shape` and `dead_end` are ours.
BUILTIN_RULES: tuple[Rule, ...] = (
    Rule(
        "aws-access-key-id", "aws", "CRITICAL", "AWS Access Key ID detected",
        r"(?:^|[^A-Za-z0-9])((?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16})(?:$|[^A-Za-z0-9])",
        ("akia", "abia", "acca", "asia"), shape="run",
    ),
    Rule(
        "aws-secret-access-key", "aws", "CRITICAL", "AWS Secret Access Key detected",
        r"""(?:aws_secret_access_key|aws_secret_key|secret_key|secret_access_key)[\s]*[=:]\s*["']?([A-Za-z0-9/+=]{40})["']?""",
        ("aws_secret", "secret_key", "secret_access"), ignore_case=True, shape="assignment",
    ),
    Rule(
        "aws-mws-token", "aws", "HIGH", "AWS MWS Auth Token detected",
        r"amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
        ("amzn.mws",), shape="run",
    ),
    Rule(
        "aws-session-token", "aws", "HIGH", "AWS Session Token detected",
        r"""(?:aws_session_token|session_token)[\s]*[=:]\s*["']?([A-Za-z0-9/+=]{100,})["']?""",
        ("session_token", "aws_session"), ignore_case=True, shape="assignment",
    ),
    Rule(
        "jwt-token", "jwt", "HIGH", "JWT Token detected",
        r"(?:^|[^A-Za-z0-9._-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?:$|[^A-Za-z0-9._-])",
        ("eyj",), shape="run",
    ),
    Rule(
        "jwt-bearer-token", "jwt", "HIGH", "JWT Bearer Token detected in authorization header",
        r"[Bb]earer\s+([A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})",
        ("bearer",), shape="run",
    ),
    Rule(
        "jwt-assignment", "jwt", "HIGH", "JWT Token assigned to variable",
        r"""(?:jwt|token|auth_token|access_token|id_token|refresh_token)[\s]*[=:]\s*["']?(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})["']?""",
        ("jwt", "token", "auth_token", "access_token", "id_token"), ignore_case=True, shape="assignment",
    ),
    Rule(
        "github-pat", "github", "CRITICAL", "GitHub Personal Access Token detected",
        r"(?:^|[^A-Za-z0-9_])(ghp_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])",
        ("ghp_",), shape="run",
    ),
    Rule(
        "github-oauth-token", "github", "CRITICAL", "GitHub OAuth Access Token detected",
        r"(?:^|[^A-Za-z0-9_])(gho_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])",
        ("gho_",), shape="run",
    ),
    Rule(
        "github-user-token", "github", "HIGH", "GitHub User-to-Server Token detected",
        r"(?:^|[^A-Za-z0-9_])(ghu_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])",
        ("ghu_",), shape="run",
    ),
    Rule(
        "github-server-token", "github", "HIGH", "GitHub Server-to-Server Token detected",
        r"(?:^|[^A-Za-z0-9_])(ghs_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])",
        ("ghs_",), shape="run",
    ),
    Rule(
        "github-refresh-token", "github", "HIGH", "GitHub Refresh Token detected",
        r"(?:^|[^A-Za-z0-9_])(ghr_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])",
        ("ghr_",), shape="run",
    ),
    Rule(
        "github-fine-grained-pat", "github", "CRITICAL", "GitHub Fine-grained PAT detected",
        r"(?:^|[^A-Za-z0-9_])(github_pat_[A-Za-z0-9_]{22,82})(?:$|[^A-Za-z0-9_])",
        ("github_pat_",), shape="run",
    ),
    Rule(
        "database-url-credentials", "generic", "CRITICAL", "Database connection string with embedded credentials",
        r"(?:mysql|postgres|postgresql|mongodb|redis|amqp|mssql)://[^:\s]+:([^@\s]{8,})@",
        ("mysql://", "postgres://", "postgresql://", "mongodb://", "redis://", "amqp://", "mssql://"),
        ignore_case=True, shape="url", dead_end=r"://[^:\s]+:[^@\s]*+(?!@)",
    ),
    Rule(
        "database-password", "generic", "HIGH", "Database password in configuration",
        r"""(?:db_password|database_password|db_pass|mysql_password|pg_password|postgres_password|mongo_password)[\s]*[=:]\s*["']?([^\s"']{8,})["']?""",
        ("db_password", "database_password", "db_pass", "mysql_password", "pg_password"),
        ignore_case=True, shape="assignment",
    ),
    Rule(
        "ssh-private-key", "generic", "CRITICAL", "SSH/RSA Private Key detected",
        r"-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH|PGP)\s+PRIVATE\s+KEY-----",
        ("-----begin", "private key"), shape="pem",
    ),
    Rule(
        "env-secret", "generic", "HIGH", "Secret value in environment variable / config",
        r"""(?:SECRET|PASSWORD|PASSWD|TOKEN|API_KEY|APIKEY|ACCESS_KEY|PRIVATE_KEY|AUTH)[\s]*[=:]\s*["']?([^\s"'#]{8,})["']?""",
        ("secret", "password", "passwd", "token", "api_key", "apikey", "access_key", "private_key", "auth"),
        ignore_case=True, shape="assignment",
    ),
    Rule(
        "slack-token", "generic", "HIGH", "Slack Token detected",
        r"(xox[bpors]-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{10,})",
        ("xox",), shape="run",
    ),
    Rule(
        "slack-webhook", "generic", "MEDIUM", "Slack Webhook URL detected",
        r"(https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{20,})",
        ("hooks.slack.com",), shape="run",
    ),
    Rule(
        "stripe-secret-key", "generic", "CRITICAL", "Stripe Secret Key detected",
        r"(?:^|[^A-Za-z0-9_])(sk_(?:live|test)_[A-Za-z0-9]{20,})(?:$|[^A-Za-z0-9_])",
        ("sk_live", "sk_test"), shape="run",
    ),
    Rule(
        "stripe-publishable-key", "generic", "LOW", "Stripe Publishable Key detected",
        r"(?:^|[^A-Za-z0-9_])(pk_(?:live|test)_[A-Za-z0-9]{20,})(?:$|[^A-Za-z0-9_])",
        ("pk_live", "pk_test"), shape="run",
    ),
    Rule(
        "sendgrid-api-key", "generic", "HIGH", "SendGrid API Key detected",
        r"(?:^|[^A-Za-z0-9._])(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})(?:$|[^A-Za-z0-9._])",
        ("sg.",), shape="run",
    ),
    Rule(
        "twilio-api-key", "generic", "HIGH", "Twilio API Key detected",
        r"(?:^|[^A-Za-z0-9])(SK[0-9a-fA-F]{32})(?:$|[^A-Za-z0-9])",
        ("sk",), shape="run",
    ),
    Rule(
        "google-api-key", "generic", "HIGH", "Google API Key detected",
        r"(?:^|[^A-Za-z0-9_])(AIza[0-9A-Za-z_-]{35})(?:$|[^A-Za-z0-9_])",
        ("aiza",), shape="run",
    ),
    Rule(
        "heroku-api-key", "generic", "HIGH", "Heroku API Key detected",
        r"""(?:heroku_api_key|heroku_key|heroku_token)[\s]*[=:]\s*["']?([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})["']?""",
        ("heroku_api_key", "heroku_key", "heroku_token"), ignore_case=True, shape="assignment",
    ),
    Rule(
        "generic-api-key", "generic", "MEDIUM", "Generic API Key detected",
        r"""(?:api_key|apikey|api-key|x-api-key)[\s]*[=:]\s*["']?([A-Za-z0-9_\-]{20,})["']?""",
        ("api_key", "apikey", "api-key", "x-api-key"), ignore_case=True, shape="assignment",
    ),
    Rule(
        "password-in-url", "generic", "HIGH", "Password embedded in URL",
        r"://[^:\s]+:([^@\s]{8,})@[^\s]+",
        ("://",), shape="url", dead_end=r"://[^:\s]+:[^@\s]*+(?!@[^\s])",
    ),
)


def rule_catalog(spark: SparkSession, rules: tuple[Rule, ...] = BUILTIN_RULES) -> DataFrame:
    """The rules as a DataFrame, numbered from 1 in evaluation order."""
    rows = [
        (i, r.rule_id, r.group, r.description, r.severity, r.java_pattern, r.group_idx, list(r.keywords))
        for i, r in enumerate(rules, 1)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def check_patterns(spark: SparkSession, patterns: list[str]) -> None:
    """Raise ``ValueError`` for the first pattern Java cannot compile.

    Spark folds the literals on the driver, many in one query; only where one of
    them fails are they asked singly.
    """

    def compiles(some: list[str]) -> None:
        spark.range(1).select(*[F.regexp_like(F.lit(""), F.lit(p)).alias(f"p{i}") for i, p in enumerate(some)]).collect()

    for start in range(0, len(patterns), CHECKED_TOGETHER):
        some = patterns[start : start + CHECKED_TOGETHER]
        try:
            compiles(some)
        except Exception:
            for pattern in some:
                try:
                    compiles([pattern])
                except Exception as error:
                    raise ValueError(f"not a valid Java regular expression: {pattern!r}") from error
            raise
