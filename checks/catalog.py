"""What the oracle SQL looks for, written down on its own: an edit of the package's rules shows as a difference."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Known:
    rule_id: str
    group: str
    severity: str
    description: str
    pattern: str
    group_idx: int
    ignore_case: bool
    keywords: tuple[str, ...]


# Rule ids, groups, severities, descriptions, patterns, reported groups, case, keywords, in order.
RULES = (
    Known(
        "aws-access-key-id", "aws", "CRITICAL", "AWS Access Key ID detected",
        r"""(?:^|[^A-Za-z0-9])((?:AKIA|ABIA|ACCA|ASIA)[A-Z0-9]{16})(?:$|[^A-Za-z0-9])""",
        1, False, ("akia", "abia", "acca", "asia"),
    ),
    Known(
        "aws-secret-access-key", "aws", "CRITICAL", "AWS Secret Access Key detected",
        r"""(?:aws_secret_access_key|aws_secret_key|secret_key|secret_access_key)[\s]*[=:]\s*["']?([A-Za-z0-9/+=]{40})["']?""",
        1, True, ("aws_secret", "secret_key", "secret_access"),
    ),
    Known(
        "aws-mws-token", "aws", "HIGH", "AWS MWS Auth Token detected",
        r"""amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}""",
        0, False, ("amzn.mws",),
    ),
    Known(
        "aws-session-token", "aws", "HIGH", "AWS Session Token detected",
        r"""(?:aws_session_token|session_token)[\s]*[=:]\s*["']?([A-Za-z0-9/+=]{100,})["']?""",
        1, True, ("session_token", "aws_session"),
    ),
    Known(
        "jwt-token", "jwt", "HIGH", "JWT Token detected",
        r"""(?:^|[^A-Za-z0-9._-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?:$|[^A-Za-z0-9._-])""",
        1, False, ("eyj",),
    ),
    Known(
        "jwt-bearer-token", "jwt", "HIGH", "JWT Bearer Token detected in authorization header",
        r"""[Bb]earer\s+([A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})""",
        1, False, ("bearer",),
    ),
    Known(
        "jwt-assignment", "jwt", "HIGH", "JWT Token assigned to variable",
        r"""(?:jwt|token|auth_token|access_token|id_token|refresh_token)[\s]*[=:]\s*["']?(eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})["']?""",
        1, True, ("jwt", "token", "auth_token", "access_token", "id_token"),
    ),
    Known(
        "github-pat", "github", "CRITICAL", "GitHub Personal Access Token detected",
        r"""(?:^|[^A-Za-z0-9_])(ghp_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])""",
        1, False, ("ghp_",),
    ),
    Known(
        "github-oauth-token", "github", "CRITICAL", "GitHub OAuth Access Token detected",
        r"""(?:^|[^A-Za-z0-9_])(gho_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])""",
        1, False, ("gho_",),
    ),
    Known(
        "github-user-token", "github", "HIGH", "GitHub User-to-Server Token detected",
        r"""(?:^|[^A-Za-z0-9_])(ghu_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])""",
        1, False, ("ghu_",),
    ),
    Known(
        "github-server-token", "github", "HIGH", "GitHub Server-to-Server Token detected",
        r"""(?:^|[^A-Za-z0-9_])(ghs_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])""",
        1, False, ("ghs_",),
    ),
    Known(
        "github-refresh-token", "github", "HIGH", "GitHub Refresh Token detected",
        r"""(?:^|[^A-Za-z0-9_])(ghr_[A-Za-z0-9]{36})(?:$|[^A-Za-z0-9_])""",
        1, False, ("ghr_",),
    ),
    Known(
        "github-fine-grained-pat", "github", "CRITICAL", "GitHub Fine-grained PAT detected",
        r"""(?:^|[^A-Za-z0-9_])(github_pat_[A-Za-z0-9_]{22,82})(?:$|[^A-Za-z0-9_])""",
        1, False, ("github_pat_",),
    ),
    Known(
        "database-url-credentials", "generic", "CRITICAL", "Database connection string with embedded credentials",
        r"""(?:mysql|postgres|postgresql|mongodb|redis|amqp|mssql)://[^:\s]+:([^@\s]{8,})@""",
        1, True, ("mysql://", "postgres://", "postgresql://", "mongodb://", "redis://", "amqp://", "mssql://"),
    ),
    Known(
        "database-password", "generic", "HIGH", "Database password in configuration",
        r"""(?:db_password|database_password|db_pass|mysql_password|pg_password|postgres_password|mongo_password)[\s]*[=:]\s*["']?([^\s"']{8,})["']?""",
        1, True, ("db_password", "database_password", "db_pass", "mysql_password", "pg_password"),
    ),
    Known(
        "ssh-private-key", "generic", "CRITICAL", "SSH/RSA Private Key detected",
        r"""-----BEGIN\s+(?:RSA|DSA|EC|OPENSSH|PGP)\s+PRIVATE\s+KEY-----""",
        0, False, ("-----begin", "private key"),
    ),
    Known(
        "env-secret", "generic", "HIGH", "Secret value in environment variable / config",
        r"""(?:SECRET|PASSWORD|PASSWD|TOKEN|API_KEY|APIKEY|ACCESS_KEY|PRIVATE_KEY|AUTH)[\s]*[=:]\s*["']?([^\s"'#]{8,})["']?""",
        1, True, ("secret", "password", "passwd", "token", "api_key", "apikey", "access_key", "private_key", "auth"),
    ),
    Known(
        "slack-token", "generic", "HIGH", "Slack Token detected",
        r"""(xox[bpors]-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{10,})""",
        1, False, ("xox",),
    ),
    Known(
        "slack-webhook", "generic", "MEDIUM", "Slack Webhook URL detected",
        r"""(https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{20,})""",
        1, False, ("hooks.slack.com",),
    ),
    Known(
        "stripe-secret-key", "generic", "CRITICAL", "Stripe Secret Key detected",
        r"""(?:^|[^A-Za-z0-9_])(sk_(?:live|test)_[A-Za-z0-9]{20,})(?:$|[^A-Za-z0-9_])""",
        1, False, ("sk_live", "sk_test"),
    ),
    Known(
        "stripe-publishable-key", "generic", "LOW", "Stripe Publishable Key detected",
        r"""(?:^|[^A-Za-z0-9_])(pk_(?:live|test)_[A-Za-z0-9]{20,})(?:$|[^A-Za-z0-9_])""",
        1, False, ("pk_live", "pk_test"),
    ),
    Known(
        "sendgrid-api-key", "generic", "HIGH", "SendGrid API Key detected",
        r"""(?:^|[^A-Za-z0-9._])(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})(?:$|[^A-Za-z0-9._])""",
        1, False, ("sg.",),
    ),
    Known(
        "twilio-api-key", "generic", "HIGH", "Twilio API Key detected",
        r"""(?:^|[^A-Za-z0-9])(SK[0-9a-fA-F]{32})(?:$|[^A-Za-z0-9])""",
        1, False, ("sk",),
    ),
    Known(
        "google-api-key", "generic", "HIGH", "Google API Key detected",
        r"""(?:^|[^A-Za-z0-9_])(AIza[0-9A-Za-z_-]{35})(?:$|[^A-Za-z0-9_])""",
        1, False, ("aiza",),
    ),
    Known(
        "heroku-api-key", "generic", "HIGH", "Heroku API Key detected",
        r"""(?:heroku_api_key|heroku_key|heroku_token)[\s]*[=:]\s*["']?([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})["']?""",
        1, True, ("heroku_api_key", "heroku_key", "heroku_token"),
    ),
    Known(
        "generic-api-key", "generic", "MEDIUM", "Generic API Key detected",
        r"""(?:api_key|apikey|api-key|x-api-key)[\s]*[=:]\s*["']?([A-Za-z0-9_\-]{20,})["']?""",
        1, True, ("api_key", "apikey", "api-key", "x-api-key"),
    ),
    Known(
        "password-in-url", "generic", "HIGH", "Password embedded in URL",
        r"""://[^:\s]+:([^@\s]{8,})@[^\s]+""",
        1, False, ("://",),
    ),
)

# The patterns of entropy candidates.
QUOTED = r"""(?:["'])([A-Za-z0-9+/=_\-]{12,})(?:["'])"""
ASSIGNED = r"""(?:=|:)\s*["']?([A-Za-z0-9+/=_\-]{12,})["']?"""
STANDALONE = r"""\b([A-Za-z0-9+/=_\-]{20,})\b"""
