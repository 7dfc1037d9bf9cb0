"""Lines with planted credentials, derived from table rows.

The test tables hold few credentials, so every row of a table is turned into
lines that look like one, or just fail to. The recipes are SQL expressions that
Spark and DuckDB both read; prefixes are glued together so that no key-like
literal stands in this file. Inputs of a recipe: ``k`` the row's key, ``h`` its
MD5 (32 hex digits), ``hu`` the same in upper case, ``s`` its SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

DIRECTIVE = "leakframe:ignore"


def _uuid(hexa: str, last: int = 12) -> str:
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, last))
    return "concat(" + ", '-', ".join(f"substr({hexa}, {a}, {n})" for a, n in cuts) + ")"


def _jwt(second: str, tail: str = "s") -> str:
    return f"'ey', 'J', substr(h, 1, 12), '.', {second}, '.', {tail}"


def _token(prefix: str, body: str, after: str = "' ok'") -> str:
    head = ", ".join(f"'{p}'" for p in prefix.split("|"))
    return f"concat('use ', {head}, {body}, {after})"


def _github(letter: str) -> tuple[str, str, str]:
    return tuple(_token(f"gh|{letter}_", f"substr(s, 1, {n})") for n in (36, 35, 37))


# rule id -> (line that matches, line with a value one character short, another case)
RECIPES: dict[str, tuple[str, str, str]] = {
    "aws-access-key-id": tuple(
        _token("AK|IA", f"substr(hu, 1, {n})", "' end'") for n in (16, 15, 17)
    ),
    "aws-secret-access-key": (
        """concat('aws_secret_access_key = "', h, substr(h, 1, 8), '"')""",
        """concat('aws_secret_access_key = "', h, substr(h, 1, 7), '"')""",
        """concat('aws_secret_access_key = "', s, '"')""",
    ),
    "aws-mws-token": (
        f"concat('amzn.', 'mws.', {_uuid('h')})",
        f"concat('amzn.', 'mws.', {_uuid('h', 11)})",
        f"concat('amzn.', 'mws.', {_uuid('hu')})",
    ),
    "aws-session-token": (
        "concat('aws_session_token=', s, s)",
        "concat('aws_session_token=', s, substr(s, 1, 35))",
        "concat('AWS_SESSION_TOKEN : ', s, s)",
    ),
    "jwt-token": (
        "concat('x ', " + _jwt("'eyJ', substr(h, 13, 12)") + ")",
        "concat('x ', " + _jwt("'eyJ', substr(h, 13, 9)") + ")",
        "concat('x ', " + _jwt("substr(h, 13, 12)") + ")",
    ),
    "jwt-bearer-token": (
        "concat('Authorization: Bearer ', h, '.', substr(h, 1, 12), '.', substr(h, 13, 12))",
        "concat('Authorization: Bearer ', substr(h, 1, 19), '.', substr(h, 1, 12), '.', substr(h, 13, 12))",
        "concat('Authorization: BEARER ', h, '.', substr(h, 1, 12), '.', substr(h, 13, 12))",
    ),
    "jwt-assignment": (
        f"concat('jwt = ', {_jwt('h')})",
        f"concat('jwt = ', {_jwt('substr(h, 1, 9)')})",
        f"concat('refresh_token: ', {_jwt('h')})",
    ),
    "github-pat": _github("p"),
    "github-oauth-token": _github("o"),
    "github-user-token": _github("u"),
    "github-server-token": _github("s"),
    "github-refresh-token": _github("r"),
    "github-fine-grained-pat": (
        _token("github_|pat_", "substr(s, 1, 22 + cast(k % 43 as int))"),
        _token("github_|pat_", "substr(s, 1, 21)"),
        _token("_github_|pat_", "substr(s, 1, 30)"),
    ),
    "database-url-credentials": (
        "concat('postgres', '://app:', substr(h, 1, 12), '@db:5432/x')",
        "concat('postgres', '://app:', substr(h, 1, 7), '@db:5432/x')",
        "concat('http', '://app:', substr(h, 1, 12), '@db:5432/x')",
    ),
    "database-password": (
        "concat('db_password = ', substr(h, 1, 10))",
        "concat('db_password = ', substr(h, 1, 7))",
        "concat('mongo_password = ', substr(h, 1, 10))",
    ),
    "ssh-private-key": (
        "concat('-----', 'BEGIN ', CASE k % 4 WHEN 0 THEN 'RSA' WHEN 1 THEN 'DSA' WHEN 2 THEN 'EC' ELSE 'OPENSSH' END,"
        " ' PRIVATE ', 'KEY-----')",
        "concat('-----', 'BEGIN RSA PRIVATE ', 'KEY----')",
        "concat('-----', 'BEGIN ', 'PRIVATE ', 'KEY-----')",
    ),
    "env-secret": (
        "concat('auth: ', substr(h, 1, 10))",
        "concat('auth: ', substr(h, 1, 7))",
        """concat('{"auth": "', substr(h, 1, 10), '"}')""",
    ),
    "slack-token": (
        "concat('xo', 'xb-', lpad(cast(k as string), 10, '0'), '-', lpad(cast(k as string), 12, '1'), '-', substr(h, 1, 12))",
        "concat('xo', 'xb-', lpad(cast(k as string), 10, '0'), '-', lpad(cast(k as string), 12, '1'), '-', substr(h, 1, 9))",
        "concat('xo', 'xz-', lpad(cast(k as string), 10, '0'), '-', lpad(cast(k as string), 12, '1'), '-', substr(h, 1, 12))",
    ),
    "slack-webhook": tuple(
        f"concat('https://', 'hooks.slack.com', '/services/T', substr({t}, 1, 8), '/B', substr(hu, 9, 8), '/', substr(h, 1, {n}))"
        for t, n in (("hu", 24), ("hu", 19), ("lower(concat('ab', h))", 24))
    ),
    "stripe-secret-key": (
        _token("sk_|live_", "substr(h, 1, 24)"),
        _token("sk_|live_", "substr(h, 1, 19)"),
        _token("task_|live_", "substr(h, 1, 24)"),
    ),
    "stripe-publishable-key": (
        _token("pk_|test_", "substr(h, 1, 24)"),
        _token("pk_|test_", "substr(h, 1, 19)"),
        _token("xpk_|test_", "substr(h, 1, 24)"),
    ),
    "sendgrid-api-key": (
        _token("SG|.", "substr(h, 1, 22), '.', substr(s, 1, 43)"),
        _token("SG|.", "substr(h, 1, 22), '.', substr(s, 1, 42)"),
        _token("SG|.", "substr(h, 1, 22), '.', substr(s, 1, 43)", "'.'"),
    ),
    "twilio-api-key": (
        _token("S|K", "h"),
        _token("S|K", "substr(h, 1, 31)"),
        _token("s|k", "h"),
    ),
    "google-api-key": tuple(_token("AI|za", f"substr(s, 1, {n})") for n in (35, 34, 36)),
    "heroku-api-key": (
        f"concat('heroku_api_key=', {_uuid('h')})",
        f"concat('heroku_api_key=', {_uuid('h', 11)})",
        f"concat('other_key=', {_uuid('h')})",
    ),
    "generic-api-key": (
        "concat('x-api-key: ', substr(h, 1, 24))",
        "concat('x-api-key: ', substr(h, 1, 19))",
        "concat('api key: ', substr(h, 1, 24))",
    ),
    "password-in-url": (
        "concat('ftp', '://u:', substr(h, 1, 10), '@host')",
        "concat('ftp', '://u:', substr(h, 1, 7), '@host')",
        "concat('ftp', '://u:', substr(h, 1, 10), '@ host')",
    ),
}

# Every row gets one of five cases: match, too short, match switched off by the
# directive, the other case, two matches one separator apart.
ORDER_CASE = "substr(o_orderpriority, 1, 1)"
CUSTOMER_CASE = "translate(substr(c_mktsegment, 1, 1), 'ABFHM', '12345')"


def planted_line(rule_id: str) -> str:
    match, short, other = RECIPES[rule_id]
    return (
        f"CASE c WHEN '1' THEN {match} WHEN '2' THEN {short} WHEN '3' THEN concat({match}, ' # {DIRECTIVE}') "
        f"WHEN '4' THEN {other} ELSE concat({match}, ' ', {match}) END"
    )


_FILE_LINES = (
    "'plain first line'", "''", *[planted_line(r) for r in RECIPES],
    "concat('api_key=', upper(substr(h, 1, 10)), 'xyzuvwqrst+/', substr(s, 1, 6), '==')",
    "concat('digest ', s)", "'  '", "concat('key \"', substr(h, 1, 20), 'GHIJKLMNOPqrstuvwxyz', '\" end')",
)
FILE_COLUMNS = (
    "concat('src/customer_', cast(k as string), '.py') AS file_path",
    f"concat_ws(chr(10), {', '.join(_FILE_LINES)}) AS text",
)


def line_columns(rule_id: str) -> tuple[str, str]:
    return ("cast(k as string) AS file_path", f"{planted_line(rule_id)} AS text")


def _inputs(key: str, case: str, sha256: str) -> tuple[str, ...]:
    name = f"cast({key} as string)"
    return (f"{key} AS k", f"{case} AS c", f"md5({name}) AS h", f"upper(md5({name})) AS hu", f"{sha256.format(name)} AS s")


def _spark(rows: DataFrame, key: str, case: str, columns: tuple[str, str]) -> DataFrame:
    return rows.selectExpr(*_inputs(key, case, "sha2({}, 256)")).selectExpr(*columns)


def _duckdb(table: str, key: str, case: str, columns: tuple[str, str]) -> str:
    inputs = ", ".join(_inputs(key, case, "sha256({})"))
    return f"SELECT {', '.join(columns)} FROM (SELECT {inputs} FROM {table}) AS inputs"


def order_lines(orders: DataFrame, rule_id: str) -> DataFrame:
    """(file_path, text): one planted line of one rule per order."""
    return _spark(orders, "o_orderkey", ORDER_CASE, line_columns(rule_id))


def order_lines_sql(rule_id: str) -> str:
    return _duckdb("orders", "o_orderkey", ORDER_CASE, line_columns(rule_id))


def customer_files(customer: DataFrame) -> DataFrame:
    """(file_path, text): a file per customer, with a line per rule, prose and blank lines."""
    return _spark(customer, "c_custkey", CUSTOMER_CASE, FILE_COLUMNS)


def customer_files_sql() -> str:
    return _duckdb("customer", "c_custkey", CUSTOMER_CASE, FILE_COLUMNS)
