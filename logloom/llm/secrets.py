"""Secret scans with multipart credential linking.

Strong parts are reported wherever they stand. Weak parts (login names, endpoints, random-looking
strings) are reported only together with complementary parts of their scope. Which part lies in
which scope is an interval join of parts and scopes on (document, range). As the scopes of a document
never overlap, it is done as a sweep in text order that numbers them: linear in the number of parts,
where a join on document and range would compare every part with every scope of a long text.

Scopes are stanzas: text between blank lines. Only the scope bounds a link, at whatever distance its
parts stand. Positions are code points, ends are exclusive.

Defined results: a null text is an empty text; repeated rows each get their own row; documents
without parts get zero counts and empty spans; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.text import whole

IDENTIFIER, SECRET, ENDPOINT, BREAK = "identifier", "secret", "endpoint", "break"


@dataclass(frozen=True)
class Part:
    """A kind of match: `group` must have `least` characters, and match `also` where given."""

    kind: str
    role: str
    strong: bool
    pattern: str
    group: int = 0
    least: int = 1
    also: str = ""


PARTS = (
    Part("assign", SECRET, True,
         r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Part("access", IDENTIFIER, True, r"AKIA[A-Z0-9]+", 0, 18),
    Part("hex", SECRET, True, r"[0-9a-f]+", 0, 16),
    Part("login", IDENTIFIER, False,
         r"(?i)\b(user(?:_?name)?|login|client_?id|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@+-]+)", 2, 3),
    Part("random", SECRET, False, r"[A-Za-z0-9+/_-]+", 0, 20, r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])"),
    Part("endpoint", ENDPOINT, False, r"(?i)\b[a-z][a-z0-9+]{1,15}://[^\s\"'<>]+", 0, 8),
)
STANZA = Part("break", BREAK, False, r"\n[ \t\r]*\n\s*")
# a part that can hold needs at least this; rows without it skip the search for positions
QUICK = {
    "hex": r"[0-9a-f]{16}", "access": r"AKIA[A-Z0-9]{14}", "random": r"[A-Za-z0-9+/_-]{20}",
    "endpoint": r"://", "login": r"(?i)(user|login|client|account)", "assign": r"(?i)(pass|secret|token|api_?key)",
}


def _found(text: Column, part: Part, number: int, when: Column) -> Column:
    """Matches of a part in order: kind number, index, length of the gap before, length, whether it counts.

    Splitting at the pattern gives the gaps between the matches, so lengths add up to positions.
    """
    pattern = F.lit(part.pattern)
    gaps = F.transform(F.split(text, part.pattern, -1), lambda x: F.length(x))

    def described(hit: Column, i: Column) -> Column:
        value = hit if part.group == 0 else F.regexp_extract(hit, part.pattern, part.group)
        counts = F.length(value) >= part.least
        if part.also:
            counts = counts & value.rlike(part.also)
        return F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(hit).alias("length"), counts.alias("ok"))

    hits = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), described)
    joined = F.zip_with(hits, gaps, lambda h, gap: F.struct(
        h["kind"].alias("kind"), h["i"].alias("i"), h["length"].alias("length"), h["ok"].alias("ok"), gap.alias("gap")))
    # the gap after the last match has no match beside it
    return F.when(when, F.filter(joined, lambda x: x["i"].isNotNull())).otherwise(F.array().cast(
        "array<struct<kind:int,i:int,length:int,ok:boolean,gap:int>>"))


def find_parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match and one with nulls per document: uid, doc_id, kind, start, end, ok.

    Failing matches stay in, because a search goes on behind them; `ok` tells them apart.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), whole(text_col).alias("t")
    )
    flags = rows.select("*", *[F.col("t").rlike(QUICK[p.kind]).alias(f"has_{p.kind}") for p in PARTS])
    strong = [i for i, p in enumerate(PARTS) if p.strong]
    weak = [i for i, p in enumerate(PARTS) if not p.strong]
    roles = {r: [p.kind for p in PARTS if p.role == r] for r in (IDENTIFIER, SECRET, ENDPOINT)}

    def any_of(kinds: list[str]) -> Column:
        out = F.lit(False)
        for kind in kinds:
            out = out | F.col(f"has_{kind}")
        return out

    # weak parts matter only where two roles can meet
    present = [any_of(kinds).cast("int") for kinds in roles.values()]
    linkable = (present[0] + present[1] + present[2] >= 2) & any_of([PARTS[i].kind for i in weak])
    parts = [_found(F.col("t"), PARTS[i], i, F.col(f"has_{PARTS[i].kind}")) for i in strong]
    parts += [_found(F.col("t"), PARTS[i], i, linkable & F.col(f"has_{PARTS[i].kind}")) for i in weak]
    parts.append(_found(F.col("t"), STANZA, len(PARTS), linkable))
    none = F.array(F.lit(None)).cast("array<struct<kind:int,i:int,length:int,ok:boolean,gap:int>>")
    exploded = flags.select("uid", "doc_id", F.explode(F.concat(none, *parts)).alias("m")).select("uid", "doc_id", "m.*")
    # one exchange by document serves all windows and the final grouping
    by_kind = Window.partitionBy("uid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = exploded.repartition(F.col("uid")).withColumn("end", F.sum(F.col("gap") + F.col("length")).over(by_kind))
    return placed.select("uid", "doc_id", "kind", "ok", (F.col("end") - F.col("length")).alias("start"), "end")


def link_parts(parts: DataFrame) -> DataFrame:
    """The parts to report: strong ones, and weak ones with complementary parts in their scope.

    A weak secret needs an identifier or an endpoint, a login needs a secret, an endpoint needs both.
    Weak parts that overlap a strong one are part of it and not counted again.
    """
    role = F.element_at(F.array(*[F.lit(p.role) for p in (*PARTS, STANZA)]), F.col("kind") + 1)
    strong = F.element_at(F.array(*[F.lit(p.strong) for p in (*PARTS, STANZA)]), F.col("kind") + 1)
    parts = parts.filter(F.col("kind").isNull() | F.col("ok")).withColumns({"role": role, "strong": strong})
    sweep = Window.partitionBy("uid").orderBy("start", "kind")
    before = sweep.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("uid").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(
        Window.unboundedPreceding, -1)
    placed = parts.withColumns({
        "scope": F.sum((F.col("role") == BREAK).cast("int")).over(sweep.rowsBetween(Window.unboundedPreceding, 0)),
        "held": F.coalesce(F.max(F.when(F.col("strong"), F.col("end"))).over(before) > F.col("start"), F.lit(False))
        | F.coalesce(F.min(F.when(F.col("strong"), F.col("start"))).over(after) < F.col("end"), F.lit(False)),
    })
    # breaks and weak parts inside strong ones take no part in linking
    counted = placed.filter(F.col("kind").isNull() | F.col("strong") | ((F.col("role") != BREAK) & ~F.col("held")))
    scope = Window.partitionBy("uid", "scope")

    def met_in_scope(wanted: str) -> Column:
        return F.max(F.coalesce(F.col("role") == wanted, F.lit(False))).over(scope)

    met = counted.withColumns({
        "by_id": met_in_scope(IDENTIFIER), "by_secret": met_in_scope(SECRET), "by_end": met_in_scope(ENDPOINT)})
    complete = (
        F.when(F.col("role") == SECRET, F.col("by_id") | F.col("by_end"))
        .when(F.col("role") == IDENTIFIER, F.col("by_secret"))
        .otherwise(F.col("by_id") & F.col("by_secret"))
    )
    return met.select(
        "uid", "doc_id", "kind", "strong", "start", "end",
        (F.col("kind").isNotNull() & (F.col("strong") | complete)).alias("reported"),
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its spans in order as (start, kind, end)."""
    kinds = F.array(*[F.lit(p.kind) for p in PARTS])
    span = F.when(F.col("reported"), F.struct(
        F.col("start").alias("start"), F.col("kind").alias("number"), F.col("end").alias("end"),
        F.element_at(kinds, F.col("kind") + 1).alias("kind"), F.col("strong").alias("strong")))
    return (
        link_parts(find_parts(docs, id_col, text_col))
        .groupBy("uid", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("uid")
    )


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(scan: DataFrame) -> DataFrame:
    """Counts and digests of the strong parts, and all spans as text."""
    base = F.filter("spans", lambda s: s["strong"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("bigint").alias(f"n_{kind}")

    return scan.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["strong"])).cast("bigint").alias("n_linked"),
    )


def merged_spans(scan: DataFrame) -> DataFrame:
    """doc_id and disjoint (start, end) pieces in order, for documents with spans; repeated rows give one row."""
    rows = scan.filter(F.size("spans") > 0).dropDuplicates(["doc_id"]).select("doc_id", F.explode("spans").alias("s"))
    rows = rows.select("doc_id", "s.start", "s.end")
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = rows.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("pieces"))


def redact(text: Column, pieces: Column, mark: str = "[SECRET]") -> Column:
    """The text with every piece (disjoint, in order) replaced by `mark`."""

    def following(p: Column, i: Column) -> Column:
        stop = F.coalesce(F.get(pieces, i + 1)["start"], F.length(text))
        return F.concat(F.lit(mark), F.substring(text, (p["end"] + 1).cast("int"), (stop - p["end"]).cast("int")))

    head = F.substring(text, F.lit(1), F.coalesce(F.get(pieces, F.lit(0))["start"], F.length(text)).cast("int"))
    return F.concat(head, F.array_join(F.transform(pieces, following), ""))
