"""Fixed cases for rules, lines, entropy, options and roll-ups."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks import registry
from leakframe import Rule, ScanOptions, check_patterns, rule_catalog, scan_texts, should_block, summary, verdict
from leakframe.functions import text
from leakframe.operators import entropy, findings as roll, gate
from leakframe.operators.allowlist import drop_allowlisted
from leakframe.operators.detect import rule_values
from leakframe.operators.entropy import scored_hits
from leakframe.operators.gate import fewest_different
from leakframe.operators.lines import split_lines
from leakframe.operators.rule_table import detect_by_table, rule_index
from leakframe.operators.skew import filter_join
from leakframe.plans import scan as plan
from leakframe.rules import BUILTIN_RULES, count_groups
from leakframe.severity import parse_severity, severity_dimension, severity_level

AWS = "AKIA" + "IOSFODNN7EXAMPLE"
SHA = hashlib.sha256(b"1").hexdigest()
MIXED = "aB3xkL9mN2pQ7rS5tU8vW1xY4zA6bC0dE"


def scan(spark, content, options=ScanOptions()):
    frame = spark.createDataFrame([("f.py", content)], "file_path STRING, text STRING")
    return scan_texts(frame, options).orderBy("line_number", "match_order").collect()


def ids(found):
    return [r.rule_id for r in found]


@pytest.mark.parametrize("content,prefix", [
    (f'aws_key = "{AWS}"', "aws"),
    ("token = ghp" + "_" + "a1B2" * 9 + " end", "github"),
    ('key = "sk' + '_live_' + "a1b2" * 6 + '"', "stripe"),
    ("-----BEGIN RSA " + "PRIVATE KEY-----\nMIIE", "ssh"),
    ("url = postgres" + "://user:secretpassword@host/db", "database-url"),
])
def test_positive(spark, content, prefix):
    assert any(rule_id.startswith(prefix) for rule_id in ids(scan(spark, content)))


def test_clean_and_ignored(spark):
    assert scan(spark, "") == []
    assert scan(spark, f"key = {AWS}  # leakframe:ignore") == []
    assert scan(spark, f"key = {AWS}  # pragma: safe", ScanOptions(ignore_directive="pragma: safe")) == []
    assert "aws-access-key-id" not in ids(scan(spark, f"key = {AWS}", ScanOptions(allowlist=(AWS.lower(),))))


def test_keywords(spark):
    def rule(*keywords):
        return ScanOptions(rule_groups=(), entropy_enabled=False, custom_rules=(Rule("r", "mine", "HIGH", "d", "AKIA[A-Z0-9]{16}", keywords),))
    assert len(scan(spark, f"x {AWS}", rule("akia"))) == 1
    assert len(scan(spark, f"x {AWS}", rule())) == 1
    assert scan(spark, f"x {AWS}", rule("absent")) == []


def test_derived_cases(spark):
    token = "gh" + "p_" + "x" * 36
    assert ids(scan(spark, f"{token} {token}")).count("github-pat") == 1
    assert ids(scan(spark, f"{token}  {token}")).count("github-pat") == 2
    assert ids(scan(spark, f'token = "{SHA}"')) == ["env-secret"]
    assert ids(scan(spark, f"token = &quot;{SHA}&quot;")) == ["env-secret", "entropy-detection"]
    (hit,) = scan(spark, "01234567890123456789")
    assert (hit.rule_id, hit.severity) == ("entropy-detection", "LOW")
    assert scan(spark, "a1" * 128 + "b") == []
    value = "aB3dE5fG7hI9jK1lM3nO5pQ7rS9t"
    assert {r.raw_value for r in scan(spark, f"k={value}== x")} == {f"{value}==", f"k={value}"}
    found = scan(spark, f" \n\n {AWS} ")
    assert [r.line_number for r in found][0] == 3
    jwt = "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12
    assert ids(scan(spark, f'token = "{jwt}"'))[:3] == ["jwt-token", "jwt-assignment", "env-secret"]


def test_variable_syntax_in_pattern(spark):
    rule = Rule("v", "mine", "LOW", "d", r"a${1}|it's \$\{(x)\}")
    options = ScanOptions(rule_groups=(), entropy_enabled=False, custom_rules=(rule,))
    assert [r.raw_value for r in scan(spark, "it's ${x}", options)] == ["x"]


def column(spark, values, expression):
    frame = spark.createDataFrame([(v,) for v in values], "v STRING")
    return [r[0] for r in frame.select(expression(F.col("v"))).collect()]


def test_entropy_values(spark):
    got = column(spark, ["", "a", "aaaaaaa", "ab", "abcd"], text.shannon_entropy)
    assert got == [0.0, 0.0, 0.0, 1.0, 2.0]
    mixed, low, hexa = column(spark, ["aB3xK9mN2pQ7rS5", "aaabbb", "deadbeef01234567"], text.shannon_entropy)
    assert mixed > 3.5 and low < 1.5 and hexa > 2.0


def test_classes(spark):
    assert column(spark, ["deadbeef1234", "not_hex_xyz", "", "ab\n"], text.is_hex) == [True, False, True, False]
    assert column(spark, ["SGVsbG8gV29ybGQ=", "has spaces!", "abc+def/ghi="], text.is_base64) == [True, False, True]
    assert column(spark, ["ff", "fg+", "a-b"], text.string_type) == ["hex", "base64", "generic"]


def test_candidates(spark):
    lines = ['key = "abcdefghijklmnop"', "key = 'abcdefghijklmnop'", "key=abcdefghijklmnop", 'x = "short"', "", "plain prose of words"]
    got = column(spark, lines, lambda c: entropy.candidate_set(c, ScanOptions()))
    assert [bool(g) for g in got] == [True, True, True, False, False, False]


def test_entropy_hits(spark):
    loose = ScanOptions(rule_groups=(), entropy_threshold=3.5)
    (hit,) = scan(spark, f'v "{MIXED}"', loose)
    assert hit.detection_method == "entropy" and hit.raw_value == MIXED
    assert hit.matched_value == MIXED[:4] + "*" * (len(MIXED) - 4)
    assert scan(spark, "this is a perfectly normal sentence of prose", ScanOptions()) == []
    assert scan(spark, f'v "{MIXED}"', ScanOptions(entropy_enabled=False)) == []


def test_description_rounds_half_even(spark):
    described = entropy.entropy_description(F.lit(3.125), F.lit("00"), ScanOptions())
    got = spark.range(1).select(described).first()[0]
    assert got == "High entropy hex string detected (entropy: 3.12, threshold: 3.00)"


@pytest.mark.parametrize("bits,length,kind,level", [
    (5.5, 45, "base64", "CRITICAL"), (5.0, 20, "generic", "HIGH"), (4.5, 15, "generic", "MEDIUM"),
    (3.5, 15, "generic", "LOW"), (4.8, 41, "hex", "CRITICAL"), (4.5, 31, "base64", "HIGH"), (4.7, 30, "generic", "MEDIUM"),
])
def test_entropy_severity(spark, bits, length, kind, level):
    got = spark.range(1).select(entropy.entropy_severity(F.lit(bits), F.lit(length), F.lit(kind))).first()[0]
    assert got == level


def test_masks(spark):
    values = ["", "ab", "abcd", "abcde", "x" * 40]
    assert column(spark, values, text.mask_rule_value) == ["", "**", "****", "abcd*", "xxxx" + "*" * 20]
    assert column(spark, values, text.mask_entropy_value) == ["", "**", "****", "abcd*", "xxxx" + "*" * 36]


def test_blank(spark):
    values = ["", " \t", " ", " 　\x1c\x85", "x", "​"]
    assert column(spark, values, text.is_blank) == [True, True, True, True, False, False]


def test_catalog(spark):
    rows = rule_catalog(spark).orderBy("ordinal").collect()
    assert len(rows) == 27 and [r.ordinal for r in rows] == list(range(1, 28))
    assert [g for i, g in enumerate(r.rule_group for r in rows) if i in (0, 4, 7, 13)] == ["aws", "jwt", "github", "generic"]
    assert {r.rule_id for r in rows if r.group_idx == 0} == {"aws-mws-token", "ssh-private-key"}
    assert [r[0] for r in severity_dimension(spark).orderBy("rank").collect()] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_rule_checks(spark):
    assert [count_groups(p) for p in (r"(a)(?:b)(?<n>c)(?<!d)(?=e)", r"\(a[(]", "[[(]b](c)")] == [2, 0, 1]
    check_patterns(spark, [r.java_pattern for r in BUILTIN_RULES])
    with pytest.raises(ValueError, match="regular expression"):
        check_patterns(spark, ["(open"])
    with pytest.raises(ValueError):
        Rule("r", "g", "nope", "d", "x")


def test_severity(spark):
    assert parse_severity(" low ") == "LOW" and parse_severity("HIGH") == "HIGH"
    with pytest.raises(ValueError, match="CRITICAL"):
        parse_severity("INVALID")
    assert column(spark, [" high", "\tHIGH\n", None], severity_level) == ["HIGH", "HIGH", None]
    with pytest.raises(Exception, match="unknown severity"):
        column(spark, ["INVALID"], severity_level)


def test_options():
    options = ScanOptions().override({"entropy": {"threshold": 4.0}, "rules": {"jwt": False}, "scanning": {"max_file_size_mb": 1}})
    assert options.entropy_threshold == 4.0 and options.hex_entropy_threshold == 3.0
    assert options.rule_groups == ("aws", "github", "generic") and options.max_file_bytes == 1024 * 1024
    assert options.override({"allowlist": {"values": ["a"], "files": ["*.x"]}}).allowlist == ("a",)
    assert len(ScanOptions().binary_extensions) == 47 and len(ScanOptions().binary_signatures) == 18
    with pytest.raises(ValueError):
        ScanOptions(rule_groups=("nope",))
    for sections in ({"entropie": {}}, {"entropy": {"treshold": 1.0}}, {"rules": {"awss": False}}):
        with pytest.raises(ValueError, match="unknown options"):
            ScanOptions().override(sections)
    with pytest.raises(ValueError):
        ScanOptions(block_level="nope")
    assert ScanOptions().rule_set_id == ScanOptions(block_level="LOW").rule_set_id != ScanOptions(max_length=99).rule_set_id


def made(spark, *severities):
    rows = [(f"f{i}", i, "r", "d", s, "m", "raw", "regex", 0) for i, s in enumerate(severities)]
    return spark.createDataFrame(
        rows, "file_path STRING, line_number INT, rule_id STRING, description STRING, severity STRING, "
        "matched_value STRING, raw_value STRING, detection_method STRING, match_order INT"
    )


@pytest.mark.parametrize("severities,blocks,top", [
    ((), False, None), (("HIGH",), True, "HIGH"), (("LOW",), False, "LOW"), (("CRITICAL",), True, "CRITICAL"),
    (("LOW", "CRITICAL", "MEDIUM"), True, "CRITICAL"),
])
def test_verdict(spark, severities, blocks, top):
    found = made(spark, *severities)
    assert should_block(found) is blocks and verdict(found).first()[0] is blocks
    assert roll.max_severity(found).first()[0] == top
    row = summary(found).first()
    assert (row.total, row.should_block, row.max_severity, row.files_affected) == (len(severities), blocks, top, len(severities))
    assert row.by_severity == {s: severities.count(s) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")}
    assert dict(map(tuple, roll.severity_counts(found).collect())) == row.by_severity


def test_filters_and_forms(spark):
    found = made(spark, "HIGH", "HIGH", "LOW")
    assert roll.with_severity(found, "high").count() == 2 and roll.in_file(found, "f2").count() == 1
    assert roll.total_findings(found).first()[0] == 3
    public = roll.public_findings(found)
    assert public.columns == ["file", "line", "rule_id", "description", "severity", "matched_value", "detection_method"]
    assert roll.alert_lines(found).first() == (
        "Possible r or sensitive data detected at line 0 of file f0", "[HIGH] f0:0 - r: m"
    )
    scanned = spark.createDataFrame([("f0",), ("f9",)], "file_path STRING")
    assert dict(map(tuple, roll.findings_per_file(scanned, found).collect())) == {"f0": 1, "f9": 0}
    allowed = spark.createDataFrame([("RAW",), (None,)], "value STRING")
    assert drop_allowlisted(found, allowed).count() == 0
    assert drop_allowlisted(found, allowed.where("value = 'x'")).count() == 3


def test_scan_selected(spark):
    texts = spark.createDataFrame([("a", AWS), ("b", AWS), ("c", "x")], "file_path STRING, text STRING")
    wanted = spark.createDataFrame([("a",), ("a",), ("c",)], "file_path STRING")
    assert [r.file_path for r in plan.scan_selected(texts, wanted).collect()] == ["a"]


def test_bad_custom_patterns_fail_when_a_scan_is_built(spark):
    texts = spark.createDataFrame([("a", "b")], "file_path STRING, text STRING")
    for options in (ScanOptions(custom_rules=(Rule("r", "custom", "LOW", "d", "(oops"),)), ScanOptions(ignore_line_patterns=("[",))):
        with pytest.raises(ValueError, match="not a valid"):
            scan_texts(texts, options)


def test_plan_has_no_shuffle_and_one_pass(spark):
    """Detection is map-only, and no pattern is evaluated in a filter a second time."""
    texts = spark.createDataFrame([("a", "b")], "file_path STRING, text STRING")
    tree = scan_texts(texts)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in tree and "Python" not in tree
    assert tree.count("AKIA|ABIA") == 1 and tree.count("lower(line") == 1


def test_filter_join_on_a_hot_key(spark):
    rows = spark.range(9000).select(
        F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v")
    ).unionByName(spark.createDataFrame([(None, 1)], "k STRING, v BIGINT"))
    keys = spark.createDataFrame([("hot",), ("hot",), ("3000",), (None,)], "k STRING")
    with_key = filter_join(rows, keys, ["k"], "left_semi", ["v"])
    without = filter_join(rows, keys, ["k"], "left_anti", ["v"])
    assert (with_key.count(), without.count()) == (3001, 6000)
    assert with_key.columns == without.columns == rows.columns


def test_entropy_of_long_values(spark, monkeypatch):
    """The same number whichever way the characters are counted, and time in proportion to the length."""
    rng = random.Random(6)
    values = ["".join(rng.choices("abcé中 \U0001f600\n", k=rng.randrange(1, 60))) for _ in range(200)] + ["a", "ab" * 40]
    frame = spark.createDataFrame([(v,) for v in values], "v STRING")
    short = [r[0] for r in frame.select(text.shannon_entropy(F.col("v"))).collect()]
    monkeypatch.setattr(text, "COUNTED_SORTED", 0)
    assert [r[0] for r in frame.select(text.shannon_entropy(F.col("v"))).collect()] == short
    took = []
    for n in (1_000, 200_000, 400_000):
        value = "".join(rng.choices([chr(0x4E00 + i) for i in range(1000)], k=n))
        counts = Counter(value)
        start = time.perf_counter()
        got = spark.createDataFrame([(value,)], "v STRING").select(text.shannon_entropy(F.col("v"))).first()[0]
        took.append(time.perf_counter() - start)
        assert got == pytest.approx(-sum(c / n * math.log2(c / n) for c in counts.values()))
    assert took[2] < 3 * took[1] + 2


def test_the_gate_knows_every_key_name(spark):
    """A line with the least that a rule takes passes, for all names of all assignment rules, in any case and spacing."""
    ruled = [r for r in BUILTIN_RULES if r.shape == "assignment"]
    names = [n for r in ruled for n in re.match(r"\(\?:([^)]*)\)", r.pattern)[1].split("|")]
    lines = [f"{form}{gap}{value}" for n in names for form in (n, n.upper(), n.title()) for gap in ("=", ":", " = ", "=\u3000'") for value in ("a1b2c3d4",)]
    frame = spark.createDataFrame([(x,) for x in lines], "line STRING")
    assert len(names) > 30 and frame.where(~gate.shape_test(F.col("line"), "assignment")).count() == 0
    other = spark.createDataFrame([("colour=a1b2c3d4",), ("token=short",), ("tokens=a1b2c3d4",)], "line STRING")
    assert other.where(gate.shape_test(F.col("line"), "assignment")).count() == 0


def test_rules_as_a_table_report_what_branches_report(spark):
    """The same findings as by one branch for each rule, in a plan of the same size for few rules and for many."""
    rng = random.Random(12)
    rules = [
        Rule("order", "custom", "HIGH", "Order code", r"order\s+([0-9]{4})", ("order",)), Rule("two", "custom", "LOW", "Two keywords", r"(?:alpha|beta)-([a-z]+)", ("alpha", "beta")),
        Rule("whole", "custom", "LOW", "Whole match", "xyz[0-9]+", ("xyz",)), Rule("empty", "custom", "LOW", "May be empty", "key=([A-F]*)", ("key=",)), Rule("any", "custom", "LOW", "Any case", "SECRET-([a-z]+)", ("secret",), ignore_case=True),
    ]
    words = ["order", "1234", "order 9876", "alpha-abc", "beta-x", "alpha beta-zz", "xyz12", "key=", "key=ABC", "Secret-Word", "é", "", "leakframe:ignore", "or"]
    content = "\n".join(" ".join(rng.choices(words, k=rng.randrange(6))) for _ in range(300))
    table = split_lines(spark.createDataFrame([("f", content)], "file_path STRING, text STRING"))
    columns = ("line_number", "rule_id", "severity", "raw_value", "matched_value")
    rows = lambda frame: sorted(tuple(r[c] for c in columns) for r in frame.collect())
    by_branch = scan_texts(spark.createDataFrame([("f", content)], "file_path STRING, text STRING"), ScanOptions(rule_groups=(), custom_rules=tuple(rules), entropy_enabled=False))
    assert rows(detect_by_table(table, rule_index(spark, rules))) == rows(by_branch) != []
    size = lambda n: len(detect_by_table(table, rule_index(spark, rules * n))._jdf.queryExecution().optimizedPlan().toString())
    assert abs(size(1) - size(400)) < 200
    for keywords in ((), ("ab",)):
        with pytest.raises(ValueError, match="needs keywords"):
            rule_index(spark, [Rule("r", "custom", "LOW", "d", "ab", keywords)])


def test_the_rule_index_is_sent_and_not_the_triples_of_lines(spark):
    """Spark knows the size of neither, and sent the triples of all lines where their table was small."""
    index = rule_index(spark, [Rule("r", "custom", "LOW", "d", "abc([0-9])", ("abc",))])
    table = spark.createDataFrame([("f", 1, "abc1 abc2")], "file_path STRING, line_number INT, line STRING")
    found = detect_by_table(table, index)
    assert sorted(r.raw_value for r in found.collect()) == ["1", "2"]
    join = next(part for part in found._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in part)
    assert "BuildRight" in join


def test_many_patterns_are_checked_by_few_jobs(spark):
    context = spark.sparkContext
    context.setJobGroup("patterns", "")
    check_patterns(spark, [f"x{i}" for i in range(600)])
    assert len(context.statusTracker().getJobIdsForGroup("patterns")) <= 6
    context.setLocalProperty("spark.jobGroup.id", None)
    with pytest.raises(ValueError, match=re.escape("'y('")):
        check_patterns(spark, [*(f"x{i}" for i in range(300)), "y(", "z("])


def test_findings_are_not_scanned_again_to_be_sorted(spark):
    texts = spark.createDataFrame([("b", "x\ndb_password = abcdefgh12"), ("a", "auth: abcdefgh12")], "file_path STRING, text STRING")
    ordered = roll.in_order(scan_texts(texts))
    assert [(r.file_path, r.line_number) for r in ordered.collect()][0] == ("a", 1)
    assert "Generate" not in ordered._jdf.queryExecution().optimizedPlan().toString()


def test_the_class_of_a_value_is_asked_once_before_and_once_after_its_score(spark):
    texts = spark.createDataFrame([("a", "auth: abcdefgh12")], "file_path STRING, text STRING")
    plan = scan_texts(texts)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[0-9a-fA-F]*") == 2


def test_quick_patterns_find_what_the_patterns_find(spark):
    """Also where letters that are others' equals without case stand in key names."""
    tree = scan_texts(spark.createDataFrame([("a", "b")], "file_path STRING, text STRING"))._jdf.queryExecution().optimizedPlan().toString()
    assert "[A-Z0-9]{16}" not in tree and "(?=[APSTapstſ])" in tree
    rng = random.Random(11)
    heads = ("ſecret_key", "ıd_token", "İD_TOKEN", "toKen", "Secret_Key", "db_password", "x-api-key", "pk", "éauth", "bearer")
    values = ["".join(rng.choices("abefxzAKIF0123459+/=_-.ſKı ", k=rng.randrange(8, 60))) for _ in range(300)]
    rows = [(f"{rng.choice(heads)}{rng.choice(('=', ' : ', ': ', ' '))}{v}",) for v in values]
    rows += [(f"gh{'pousr'[i % 5]}_{'aB3' * 12} sk_live_{'a1' * 12}", ) for i in range(5)] + [("id_token=eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12,)]
    frame = spark.createDataFrame(rows, "line STRING")
    for rule in BUILTIN_RULES:
        found = frame.select(F.expr(rule_values("line", rule)).alias("quick"), F.regexp_extract_all("line", F.lit(rule.java_pattern), F.lit(rule.group_idx)).alias("plain"))
        assert found.where("quick IS DISTINCT FROM plain").count() == 0, rule.rule_id


def test_strings_of_few_different_characters_are_not_scored(spark):
    assert fewest_different(ScanOptions()) == (23, 8)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGH"
    values = [letters[:22] * 3, letters[:23], letters[:23] * 2, letters[:24] * 4, "01234567", "0123456701234567", "012345670123456", "0123456" * 9]
    frame = spark.createDataFrame([(values,)], "c ARRAY<STRING>")
    hits = frame.select(scored_hits(F.col("c"), ScanOptions()).alias("h"))
    assert [h.raw_value for h in hits.first().h] == [letters[:23], letters[:23] * 2, letters[:24] * 4, "0123456701234567"]
    assert [h.entropy for h in hits.first().h] == pytest.approx([math.log2(23), math.log2(23), math.log2(24), 3.0])
    tree = hits._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count("array_distinct") == 2 and "THEN 8 ELSE 23" in tree


def test_what_keywords_share_is_looked_for_once(spark):
    frame = spark.createDataFrame([("a", f"x gh{'p_'}{'aB3' * 12} y\nx sk{'_live_'}{'a1' * 12} y\nGH{'P_'}{'aB3' * 12}")], "file_path STRING, text STRING")
    found = scan_texts(frame, ScanOptions(entropy_enabled=False))
    assert sorted(r.rule_id for r in found.collect()) == ["github-pat", "stripe-secret-key"]
    tree = found._jdf.queryExecution().optimizedPlan().toString()
    assert tree.count(", gh) AS part_gh") == 1 and tree.count("part_gh#") > 5


def test_scored_candidates_have_the_entropy_of_their_string(spark):
    rng = random.Random(8)
    values = ["".join(rng.choices("0123456789abcdefABCDEFghijklmnopqrstuvwxyz+/=_-", k=rng.randrange(30, 90))) for _ in range(300)]
    hits = spark.createDataFrame([(values,)], "c ARRAY<STRING>").select(F.explode(scored_hits(F.col("c"), ScanOptions())).alias("h"))
    rows = hits.select("h.entropy", text.shannon_entropy(F.col("h.raw_value")).alias("whole")).collect()
    assert len(rows) > 200 and all(r.entropy == r.whole for r in rows)
    # One division for each character, not two.
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("octet_length") == 1


def test_suppressed_strings_are_joined_without_the_driver(spark, tmp_path):
    """A customer makes many findings, so that their size is estimated far too small."""
    spark.createDataFrame([(1, "BUILDING"), (2, "AUTOMOBILE")], "c_custkey BIGINT, c_mktsegment STRING").write.parquet(f"{tmp_path}/customer.parquet")
    told = registry.QUERIES["suppress_duplicates"](spark, str(tmp_path))
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
    found = registry.file_findings(spark, str(tmp_path)).collect()
    ruled = {(r.file_path, r.line_number, r.raw_value) for r in found if r.detection_method == "regex"}
    rows = told.collect()
    assert {r.reported for r in rows} == {True, False}
    assert all(r.reported == ((r.file_path, r.line_number, r.raw_value) not in ruled) for r in rows)
    assert sum(r.reported for r in rows) == sum(r.detection_method == "entropy" for r in found)
