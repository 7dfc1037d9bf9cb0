"""Secret scan with multipart credential linking. DataFrame functions only.

Base spans (``assign``, ``access``, ``hex``) are always reported. Weak parts,
that is bare key material, account names and endpoints, are too common to
report by themselves; they count only where a part that completes them lies in
the same scope of the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakframe.llm.matching import hits, joined, placed
from leakframe.llm.scratch import stored

# The patterns of the base spans, in order.
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"  # a shorter match consumes the rest of its run, which can't hold a longer one
HEX = "[0-9a-f]{16,}"
BASE = ["assign", "access", "hex"]
LEAST_VALUE = 12

# Weak parts and the role each plays; base spans have roles as well.
MATERIAL = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/]{20,}+(?![A-Za-z0-9+/_-])"
ACCOUNT = "(?i)(?:user_?name|user|login|client_?id|account)[\"']?\\x20*+[:=]\\x20*+[\"']?[A-Za-z0-9._@-]{3,}+"
ENDPOINT = "(?i)(?:https?|wss?|ftp|amqps?|s3|jdbc:[a-z]{2,}|postgres(?:ql)?|mysql|mongodb|redis)://[^\\s\"'<>]{3,}+"
ROLE = {"assign": "secret", "hex": "secret", "material": "secret", "access": "identifier", "account": "identifier", "endpoint": "endpoint"}
COMPLETED_BY = {"material": ["identifier", "endpoint"], "account": ["secret"], "endpoint": ["secret"]}
ROLE_ORDER = [*BASE, *COMPLETED_BY]
SCOPE = 200  # code points at most from the end of a part to the start of the next one in its block


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """Spans of all texts: columns ``keep``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (start, kind, end, value) by start,
    then kind; ``spans`` adds the linked weak parts (``material``, ``account``,
    ``endpoint``) that overlap no base span. Every row of ``docs`` comes back,
    repeated ones too; null or empty texts, and texts without hits, have empty
    arrays. Of clashing column names the results win.
    """
    made = {"n_assign", "n_access", "n_hex", "base", "spans", "_row", *ROLE}
    keep = [c for c in (docs.columns if keep is None else keep) if c != text and c not in made]
    t = F.coalesce(F.col(text), F.lit(""))
    table = stored(
        docs.select(*keep, t.alias("_t")).select(
            *keep,
            F.monotonically_increasing_id().alias("_row"),
            hits(F.col("_t"), ASSIGN, F.col("_t").rlike("(?i)passw|secret|token|api_?key")).alias("assign"),
            hits(F.col("_t"), ACCESS, F.col("_t").contains("AKIA")).alias("access"),
            hits(F.col("_t"), HEX).alias("hex"),
            hits(F.col("_t"), MATERIAL).alias("material"),
            hits(F.col("_t"), ACCOUNT, F.col("_t").rlike("[:=]")).alias("account"),
            hits(F.col("_t"), ENDPOINT, F.col("_t").contains("://")).alias("endpoint"),
        )
    )
    value = F.regexp_extract("value", ASSIGN, 2)
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]")
    parts = placed(table, "_row", [*ROLE]).where(
        F.when(F.col("kind") == "assign", F.length(value) >= LEAST_VALUE).when(F.col("kind") == "material", mixed).otherwise(True)
    )
    links = _linked(parts, scope)
    order = F.array_position(F.array(*[F.lit(k) for k in ROLE_ORDER]), F.col("kind"))
    span = F.struct(F.col("start"), order.alias("order"), F.col("end"), F.col("kind"), F.col("value"))
    found = links.groupBy("_row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    none = F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string,value:string>>")
    spans = F.coalesce("spans", none)
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
    return table.select(*keep, "_row").join(found, "_row", "left").select(
        *keep,
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.transform(F.filter(spans, lambda s: s["kind"].isin(BASE)), plain).alias("base"),
        F.transform(spans, plain).alias("spans"),
    )


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """Base parts, and weak ones with a completing part in their block.

    A block ends where the next part starts more than ``scope`` after the end
    of all before it, so neither long parts nor the number of parts bound it.
    That is one sorted pass over a text's parts and makes no pairs.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    parts = parts.withColumn("_role", role).withColumn("_base", F.col("kind").isin(BASE))
    by_start = Window.partitionBy("_row").orderBy("start")
    before = F.max(F.when(F.col("_base"), F.col("end"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    # From the other end, so that the frame grows with the rows: one to the last row would be worked out anew for each.
    backwards = Window.partitionBy("_row").orderBy(F.desc("start"))
    after = F.min(F.when(F.col("_base"), F.col("start"))).over(backwards.rangeBetween(Window.unboundedPreceding, 0))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    parts = parts.withColumn("_free", free & ~F.col("_base")).where(F.col("_base") | F.col("_free"))
    in_order = Window.partitionBy("_row").orderBy("start", "end", "kind")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_first", (F.col("start") - reached > scope).cast("long"))
    parts = parts.withColumn("_block", F.sum(F.coalesce("_first", F.lit(0))).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    block = Window.partitionBy("_row", "_block")
    roles = {r: F.max(F.col("_role") == r).over(block) for r in ("identifier", "secret", "endpoint")}
    parts = parts.withColumns({f"_{r}": c for r, c in roles.items()})
    linked = F.lit(False)
    for kind, completing in COMPLETED_BY.items():
        for r in completing:
            linked = linked | ((F.col("kind") == kind) & F.col(f"_{r}"))
    return parts.where(F.col("_base") | linked)


def digests(found: DataFrame, key: str) -> DataFrame:
    """``scan`` results as counts, a digest of the base spans, and all spans in one string."""
    return found.select(
        key, "n_assign", "n_access", "n_hex",
        F.sha2(F.encode(joined(F.col("base")), "utf-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
