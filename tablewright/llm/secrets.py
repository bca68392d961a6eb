"""Secrets and linked credential parts in texts, with DataFrame functions only.

Base findings stand alone: a secret given to a telling name (``assign``), a cloud access
key (``access``), a long run of hex digits (``hex``). Weak parts -- an account name or mail
address (``identifier``), an address to connect to (``endpoint``), a short or unnamed secret
(``secret``) -- mean little alone. They are reported only where complementary parts lie
close together in one scope: a secret beside an identifier or an endpoint.

The parts of one text are joined as intervals by a sweep: sorted by start, every part looks
at the last complementary part that ended before it and the next that starts after it. That
is linear in the parts of a text; no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed patterns: the base findings.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
ASSIGN_MIN = 8

# Weak parts, of any length. Look-behinds and possessive repeats keep the scan linear in long runs.
IDENTIFIER = (
    r"""(?i)(?:\b(?:user(?:name)?|login|account|client_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@+-]{3,}+)"""
    r"""|(?:(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)"""
)
ENDPOINT = (
    r"""(?i)(?:(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]++://[^\x09-\x0D\x20"'<>]++)"""
    r"""|(?:\b(?:host|hostname|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:-]{3,}+)"""
    r"""|(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?)"""
)
SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
BREAK = r"\n[ \t\r]*\n"

KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
BASE = KINDS[:3]
REACH = 200


def _hits(text: Column, kind: str, pattern: str, strong: Column | None = None) -> Column:
    """Array of (kind, no, gap, len, ok): the matches of a pattern and the characters between them."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))

    def row(p: Column, i: Column) -> Column:
        hit = p["hit"]
        if kind == "secret":
            ok = hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9]")
        elif kind == "assign":
            ok = F.length(F.regexp_extract(hit, ASSIGN, 2)) >= ASSIGN_MIN
        else:
            ok = F.lit(True)
        return F.struct(F.lit(kind).alias("kind"), i.alias("no"), F.length(p["gap"]).alias("gap"), F.length(hit).alias("len"), ok.alias("ok"))

    # The last gap has no match after it. Most texts have no match: one search tells, and nothing is cut.
    found = F.transform(F.slice(parts, 1, F.size(hits)), row)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:string,no:int,gap:int,len:int,ok:boolean>>"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Positions count code points, ends are exclusive; spans read ``kind:start:end`` by start, then
    in the order of ``KINDS``. Scopes are paragraphs (blank lines end them); ``reach`` is the
    largest distance between linked parts. A named secret too short for ``assign`` counts as a
    weak ``secret``. Weak secrets that overlap a base finding are that finding, not a second one.

    A null text counts as empty: no spans. Rows of one id are told apart by their texts; equal rows
    give equal rows. A null id is kept. Other columns are ignored, whatever their names. An empty
    table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("h"))
    found = F.concat(
        _hits(F.col("text"), "assign", ASSIGN),
        _hits(F.col("text"), "access", ACCESS),
        _hits(F.col("text"), "hex", HEX),
        _hits(F.col("text"), "identifier", IDENTIFIER),
        _hits(F.col("text"), "secret", SECRET),
        _hits(F.col("text"), "endpoint", ENDPOINT),
    )
    hits = rows.select("id", "h", F.col("text"), found.alias("found")).where(F.size("found") > 0)
    hits = hits.select("id", "h", F.inline(F.concat("found", _hits(F.col("text"), "break", BREAK))))
    hits = hits.repartition("id", "h").dropDuplicates(["id", "h", "kind", "no"])

    own = ["id", "h"]
    upto = Window.unboundedPreceding, Window.currentRow
    in_kind = Window.partitionBy(*own, "kind").orderBy("no").rowsBetween(*upto)
    spans = hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(in_kind)).withColumn("start", F.col("end") - F.col("len"))
    # A named secret that is too short for the base is a weak secret.
    weak_name = (F.col("kind") == "assign") & ~F.col("ok")
    spans = spans.where(F.col("ok") | weak_name).withColumn("kind", F.when(weak_name, "secret").otherwise(F.col("kind")))

    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = spans.withColumn("rank", rank)
    order = [F.col("start"), F.col("rank"), F.col("end")]
    before = Window.partitionBy(*own).orderBy(*order).rowsBetween(*upto)
    after = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    base = F.col("kind").isin(BASE)
    spans = (
        spans.withColumn("scope", F.count(F.when(F.col("kind") == "break", 1)).over(before))
        .withColumn("base_before", F.max(F.when(base, F.col("end"))).over(before))
        .withColumn("base_after", F.min(F.when(base, F.col("start"))).over(after))
        .where(F.col("kind") != "break")
    )
    overlaps = (F.coalesce(F.col("base_before"), F.lit(-1)) > F.col("start")) | (F.coalesce(F.col("base_after"), F.col("end")) < F.col("end"))
    spans = spans.where(base | (F.col("kind") != "secret") | ~overlaps)

    is_secret = F.col("kind").isin("assign", "hex", "secret")
    left = Window.partitionBy(*own, "scope").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy(*own, "scope").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)

    def near(part: Column) -> Column:
        gap_left = F.col("start") - F.max(F.when(part, F.col("end"))).over(left)
        gap_right = F.min(F.when(part, F.col("start"))).over(right) - F.col("end")
        return (F.coalesce(gap_left, F.lit(reach + 1)) <= reach) | (F.coalesce(gap_right, F.lit(reach + 1)) <= reach)

    spans = spans.withColumn("linked", F.when(is_secret, near(~is_secret)).otherwise(near(is_secret)))
    spans = spans.where(base | F.col("linked"))

    entry = F.struct("start", "rank", "kind", "end")
    per_doc = spans.groupBy(*own).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(entry)).alias("spans"),
        F.count(F.when(~base, 1)).alias("n_linked"),
    )

    def text_of(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    all_spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>"))
    per_doc = per_doc.withColumnsRenamed({"id": "span_id", "h": "span_h"})
    docs_only = rows.select("id", "h")
    joined = docs_only.join(per_doc, docs_only["id"].eqNullSafe(per_doc["span_id"]) & (docs_only["h"] == per_doc["span_h"]), "left")
    return joined.select(
        F.col("id").alias(id_col),
        *[F.coalesce(F.col(f"n_{k}"), F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(text_of(F.filter(all_spans, lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
        text_of(all_spans).alias("spans"),
        F.coalesce(F.col("n_linked"), F.lit(0)).cast("long").alias("n_linked"),
    )
