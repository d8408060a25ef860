"""Secret scan with multipart credential linking, in DataFrame functions only.

Patterns find parts of credentials in whole texts: identifiers, secrets and endpoints. Strong
parts (the base kinds) stand on their own. Weak ones (user names, addresses, token-like
strings, hosts) are reported only if a complementary part lies in their scope, ``SCOPE`` code
points to either side: a secret for an identifier or an endpoint, an identifier for a secret.

The texts are scanned once; what is kept of a match is its kind and the lengths of match and
gap, from which running sums give the places. Scopes are an interval join: parts are put into
buckets of ``SCOPE`` code points per document, so a bucket holds few parts however many a
document has, and only parts in neighbouring buckets meet. Matches are few beside the text;
no text is shuffled to find them.

Matches have no greatest length. Weak patterns start at borders and never give back what they
took (possessive), so a long run of one character class costs linear time.

Defined cases: a null text is empty; an empty text has no spans and the digest of the empty
string; repeated rows are scanned per row; a null doc_id stays null; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollframe.llm.common import packed, query, staged, table

SCOPE = 200
#: Kinds in the order of ties: name, role, whether strong, pattern, and what a match must hold.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_TOKEN = r"[A-Za-z0-9+/_=-]"
KINDS: list[tuple[str, str, bool, str]] = [
    ("assign", "secret", True, ASSIGN),
    ("access", "identifier", True, r"AKIA[A-Z0-9]{14,}"),
    ("hex", "secret", True, r"[0-9a-f]{16,}"),
    ("name", "identifier", False, r"""(?i)\b(?:user|username|login|account|client_?id|access_?key_?id)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9._@-]{3,}+"""),
    ("mail", "identifier", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("opaque", "secret", False, rf"(?<!{_TOKEN}){_TOKEN}{{20,}}+"),
    ("host", "endpoint", False, r"\bhttps?://[^\s\"'<>]{3,}+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}\b"),
]
BASE = 3
REPLACEMENT = "[secret]"


def _accepted(kind: str, hit: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 12
    if kind == "opaque":
        return hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    return F.lit(True)


def _links(kind: str, hit: Column) -> Column:
    """A run of digits alone is no secret that could vouch for another part."""
    return hit.rlike("[a-f]") & hit.rlike("[0-9]") if kind == "hex" else F.lit(True)


def _found(number: int, kind: str, pattern: str) -> Column:
    """All matches of a kind in order: lengths of the gap before and of the match."""
    matches = F.zip_with(
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1),
        lambda hit, gap: F.struct(
            F.lit(number).alias("kind"), F.length(gap).alias("gap"), F.length(hit).alias("len"),
            _accepted(kind, hit).alias("ok"), _links(kind, hit).alias("links")))
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean,links:boolean>>")
    return F.when(F.col("text").rlike(pattern), matches).otherwise(none)


def _buckets(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE)))


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (row, doc_id, fp) and their parts (row, kind, start, end, links); both are staged."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = staged(rows.select("doc_id", F.xxhash64("text").alias("fp"), F.monotonically_increasing_id().alias("row"),
                              F.concat(*[_found(i, k[0], k[3]) for i, k in enumerate(KINDS)]).alias("found")))
    matches = rows.filter(F.size("found") > 0).select("row", F.posexplode("found").alias("pos", "m")).select("row", "pos", "m.*").filter("len is not null")
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = matches.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(upto)).filter("ok").select(
        "row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "links")
    return rows.drop("found"), staged(parts)


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts with a complementary part in scope, and how many such parts there are.

    Weak parts that a strong one covers whole are not reported again; one that goes beyond it is.
    """
    role = F.element_at(F.array(*[F.lit(k[1]) for k in KINDS]), F.col("kind") + 1)
    weak = parts.filter(F.col("kind") >= BASE).select(
        "row", "kind", "start", "end", role.alias("role"), _buckets(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope).alias("bucket"))
    others = parts.select("row", F.col("kind").alias("kind2"), F.col("start").alias("start2"), F.col("end").alias("end2"), "links",
                          role.alias("role2"), _buckets(F.col("start"), F.col("end")).alias("bucket"))
    touch = (F.col("start") < F.col("end2")) & (F.col("start2") < F.col("end"))
    complement = F.when(F.col("role") == "secret", F.col("role2") == "identifier").otherwise(F.col("role2") == "secret")
    covered = (F.col("kind2") < BASE) & (F.col("start2") <= F.col("start")) & (F.col("end") <= F.col("end2"))
    near = (F.col("start2") <= F.col("end") + scope) & (F.col("start") <= F.col("end2") + scope)
    met = weak.join(others, ["row", "bucket"]).filter(near & (complement | covered))
    return (met.groupBy("row", "kind", "start", "end")
            .agg(F.max(covered).alias("inside"),
                 F.count_distinct(F.when(complement & ~touch & F.col("links"), F.struct("kind2", "start2"))).alias("partners"))
            .filter("not inside and partners > 0").drop("inside"))


def _listed(only_base: bool) -> Column:
    """kind:start:end of the collected parts by start, then kind."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    spans = F.filter("parts", lambda p: p["kind"] < BASE) if only_base else F.col("parts")
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.element_at(names, p["kind"] + 1), p["start"], p["end"])), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fp, counts of the base kinds, digest of the base spans, all spans, and the parts as an array."""
    rows, parts = scan(docs)
    reported = parts.filter(F.col("kind") < BASE).select("row", "kind", "start", "end", F.lit(0).cast("long").alias("partners")).unionByName(link(parts))
    per_row = reported.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "partners"))).alias("parts"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,partners:bigint>>")
    out = rows.join(per_row, "row", "left").withColumn("parts", F.coalesce("parts", none))
    count = lambda i: F.size(F.filter("parts", lambda p: p["kind"] == i)).cast("long")
    return out.select(
        "doc_id", "fp", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(True), 256).alias("base_sha256"), _listed(False).alias("spans"), "parts")


def redact(docs: DataFrame, replacement: str = REPLACEMENT) -> DataFrame:
    """The rows with every reported span replaced; ``n_chars`` follows, where there is one."""
    found = find_secrets(docs).filter(F.size("parts") > 0).groupBy(F.col("doc_id").alias("its_id"), F.col("fp").alias("its_fp")).agg(
        F.first("parts").alias("parts"))
    rows = packed(docs).withColumn("fp", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = rows.join(found, (F.col("fp") == F.col("its_fp")) & F.col("doc_id").eqNullSafe(F.col("its_id")), "left")
    # Walk the spans by start: what lies between them stays, overlapping ones become one mark.
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.array().cast("array<string>").alias("kept"))
    walked = F.aggregate("parts", start, lambda a, p: F.struct(
        F.greatest(a["upto"], p["end"]).alias("upto"),
        F.when(p["start"] >= a["upto"], F.concat(a["kept"], F.array(F.substring("text", (a["upto"] + 1).cast("int"), (p["start"] - a["upto"]).cast("int")))))
        .otherwise(a["kept"]).alias("kept")),
        lambda a: F.array_join(F.concat(a["kept"], F.array(F.substring("text", (a["upto"] + 1).cast("int"), F.length("text")))), replacement))
    both, hit = both.withColumn("masked", F.when(F.col("parts").isNotNull(), walked)), F.col("parts").isNotNull()
    row = F.col("row").withField("text", F.when(hit, F.col("masked")).otherwise(F.col("row.text")))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(hit, F.length("masked").cast("long")).otherwise(F.col("row.n_chars")))
    return both.select(row.alias("row")).select("row.*")


@query("op2_secret_scan")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return find_secrets(table(spark, sf, "documents")).drop("fp", "parts")
