"""Secret scans: multipart credential linking with DataFrame functions only.

Strong spans (assignments, access keys, long hex runs) are reported by themselves. Weak candidates (short or named
identifiers, long mixed strings, endpoints) are reported only when a complementary part stands within SCOPE
characters of the same text: an identifier beside a secret, a secret beside an identifier or endpoint, an endpoint
beside a secret. The parts meet in an interval join on (text, bin) that stops at the first partner (left semi), so
the number of pairs is never made.

Defined cases: a null text is empty and has no spans. Rows with equal doc_id and text are reported alike; a null
doc_id is a value like any other. Offsets are code points, ends exclusive. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerview.llm.common import cut

#: Fixed patterns and least lengths of the strong kinds, in the order of the kinds.
KEYWORDS = r"(?i)password|passwd|secret|token|api_?key"
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Weak kinds: (kind, class, pattern).
WEAK = (
    ("ident", "identifier", r"(?i)\b(?:client_?id|account_?id|access_?id|user(?:name)?|login)\b[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_.@-]{3,64}|\b(?:AKIA|ASIA|AIza)[A-Za-z0-9]{4,15}\b|(?<![A-Za-z0-9+/_-])(?:ASIA[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9+/_=-])"),
    ("mixed", "secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}={0,2}"),
    ("endpoint", "endpoint", r"\b(?:https?|ftp|jdbc:[a-z]+|amqp|redis|mongodb)://[^\x20\x09-\x0D\"'<>]{3,}|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?\b"),
)
SCOPE = 200
BLOCK = 256


def _ends(lengths: Column) -> Column:
    """Running sums of an array, by blocks so that long arrays stay cheap."""
    n = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(lengths, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, total)
    inner = lambda block, b: F.transform(block, lambda _, j: total(F.slice(block, 1, j + 1)) + total(F.slice(sums, 1, b)))
    return F.flatten(F.transform(blocks, inner))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs (s, e, g): start, end, and the length of a group."""
    rx = F.lit(pattern)
    found, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, pattern, -1)
    part = found if not group else F.regexp_extract_all(text, rx, F.lit(group))
    lengths = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
    spans = F.zip_with(_ends(lengths), found, lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e")))
    return F.when(F.size(found) > 0, F.zip_with(spans, part, lambda x, p: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.length(p).alias("g"))))


NONE = "array<struct<s:int,k:int,e:int,kind:string>>"


def _kind(spans: Column, order: int, kind: str, least: int = 0) -> Column:
    kept = F.filter(spans, lambda x: x["g"] >= least)
    return F.coalesce(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"))), F.array().cast(NONE))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, sig, base (strong spans in order) and weak (weak candidates where a secret is present at all)."""
    t = F.col("t")
    out = df.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    out = out.withColumn("sig", F.xxhash64("doc_id", "t"))
    out = out.withColumn("a", F.when(t.rlike(KEYWORDS), matches(t, ASSIGN, 2)))
    out = out.withColumn("b", F.when(t.contains("AKIA"), matches(t, ACCESS))).withColumn("c", F.when(t.rlike(HEX), matches(t, HEX)))
    for kind, _, pattern in WEAK[1:2]:
        out = out.withColumn(f"w_{kind}", F.when(t.rlike(pattern), _kind(matches(t, pattern), 4, kind)))
    base = F.sort_array(F.concat(_kind(F.col("a"), 0, "assign", ASSIGN_LEAST), _kind(F.col("b"), 1, "access"), _kind(F.col("c"), 2, "hex")))
    out = out.withColumn("base", base)
    secret = (F.size("base") > 0) | F.col("w_mixed").isNotNull()
    for k, (kind, _, pattern) in enumerate(WEAK):
        if kind != "mixed":
            out = out.withColumn(f"w_{kind}", F.when(secret & t.rlike(pattern), _kind(matches(t, pattern), 3 + k, kind)))
    none = F.array().cast(NONE)
    weak = F.when(secret, F.concat(*(F.coalesce(F.col(f"w_{kind}"), none) for kind, _, _ in WEAK)))
    return out.select("doc_id", "sig", "base", weak.alias("weak"))


def link(found: DataFrame) -> DataFrame:
    """sig, more: the weak candidates that have a complementary part in their scope and lie outside strong spans."""
    classes = F.create_map(*(F.lit(x) for kind, cls, _ in WEAK for x in (kind, cls)), F.lit("assign"), F.lit("secret"), F.lit("access"), F.lit("identifier"), F.lit("hex"), F.lit("secret"))
    rows = found.filter(F.size("weak") > 0).select("sig", "base", "weak").dropDuplicates(["sig"])
    inside = lambda x: F.exists("base", lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"]))
    rows = rows.withColumn("weak", F.filter("weak", lambda x: ~inside(x)))
    part = lambda name: rows.select("sig", F.explode(name).alias("x")).select("sig", "x", classes[F.col("x.kind")].alias("cls"), (F.col("x.s") / SCOPE).cast("int").alias("bin"))
    weak = part("weak")
    parts = weak.unionByName(part("base")).select("sig", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("cls").alias("other"), F.explode(F.sequence((F.col("x.s") / SCOPE).cast("int") - 1, (F.col("x.e") / SCOPE).cast("int") + 1)).alias("bin"))
    parts = parts.dropDuplicates(["sig", "bin", "other", "s", "e"])
    # a partner's bins reach one scope to both sides, so a weak part of any length meets it from the bins it covers
    weak = weak.select("sig", "x", "cls", F.explode(F.sequence("bin", (F.col("x.e") / SCOPE).cast("int"))).alias("bin"))
    weak = weak.withColumn("need", F.explode(F.when(F.col("cls") == "secret", F.array(F.lit("identifier"), F.lit("endpoint"))).otherwise(F.array(F.lit("secret")))))
    a, b = weak.alias("a"), parts.alias("b")
    near = (F.col("b.s") < F.col("a.x.e") + SCOPE) & (F.col("a.x.s") < F.col("b.e") + SCOPE)
    near &= (F.col("a.x.s") != F.col("b.s")) | (F.col("a.x.e") != F.col("b.e"))  # a span of two classes is no partner of itself
    linked = a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.need") == F.col("b.other")) & near, "left_semi")
    return linked.groupBy("sig").agg(F.collect_set("x").alias("more"))


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row of df."""
    found = cut(candidates(df, text), "secret-candidates")
    out = found.drop("weak").join(link(found), "sig", "left")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    more = F.coalesce("more", F.array().cast(NONE))
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_linked"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
