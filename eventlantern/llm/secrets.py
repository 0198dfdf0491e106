"""Secret scanning over an incremental ledger of content-addressed blobs.

Every version of a path is addressed by the SHA-256 of its text. The ledger keeps, for each blob, which
rule versions have read it and what they found. A run scans only blobs with unseen rule versions, and of
those only the unseen rules, appends the outcome, and joins findings back to every path that holds the
blob. DataFrame functions only. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, remove, scratch

SPAN = "struct<start:int,end:int,first:int,last:int,rule:string>"  # code points, then bytes
LEDGER = f"blob string, scanned array<string>, spans array<{SPAN}>"
SPANS = "array<struct<start:int,ord:int,kind:string,end:int>>"
FOUND = "blob string, spans " + SPANS + ", pieces array<struct<first:int,size:int>>"
BROADCAST_SPANS = 500_000  # findings up to this many spans are broadcast; beyond that the join is salted
SALT = 16


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of `pattern` whose group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds in the order in which ties are listed. A run of hexadecimal digits or of an access
# key is maximal, so its least length can stand in the pattern.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def address(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def matches(text: Column, todo: Column, rules: tuple[Rule, ...]) -> Column:
    """array<struct<ord, pos, gap, size, gap_bytes, size_bytes, told>>: every match of the rules in `todo` and what stands before it."""
    none = F.array().cast("array<struct<ord:int,pos:int,gap:int,size:int,gap_bytes:int,size_bytes:int,told:int>>")

    def of(order: int, rule: Rule) -> Column:
        pattern = F.lit(rule.pattern)
        whole = F.regexp_extract_all(text, pattern, F.lit(0))
        told = F.regexp_extract_all(text, pattern, F.lit(rule.group))
        pairs = F.arrays_zip(whole.alias("w"), told.alias("t"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)).alias("p"))
        one = F.transform(pairs, lambda m, k: F.struct(
            F.lit(order).alias("ord"), k.alias("pos"), F.length(m["p"]).alias("gap"), F.length(m["w"]).alias("size"),
            F.octet_length(m["p"]).alias("gap_bytes"), F.octet_length(m["w"]).alias("size_bytes"), F.length(m["t"]).alias("told"),
        ))
        return F.when(F.array_contains(todo, rule.key) & text.rlike(rule.pattern), one).otherwise(none)

    return F.concat(*[of(k, r) for k, r in enumerate(rules)])


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """LEDGER's columns of blobs(blob, text, todo): positions are running sums over the matches of a text.

    Sums are taken by a window over single matches, so the cost is linear in their number. Rows lie by
    blob already, so neither the window nor the gathering moves anything.
    """
    hits = blobs.select("blob", F.col("todo").alias("scanned"), F.explode_outer(matches(F.col("text"), F.col("todo"), rules)).alias("m"))
    upto = Window.partitionBy("blob", "m.ord").orderBy("m.pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto).cast("int")).withColumn("last", F.sum(F.col("m.gap_bytes") + F.col("m.size_bytes")).over(upto).cast("int"))
    keys, least = F.array(*[F.lit(r.key) for r in rules]), F.array(*[F.lit(r.least) for r in rules])
    span = F.struct((F.col("end") - F.col("m.size")).alias("start"), "end", (F.col("last") - F.col("m.size_bytes")).alias("first"), "last", F.get(keys, F.col("m.ord")).alias("rule"))
    kept = F.when(F.col("m.told") >= F.get(least, F.col("m.ord")), span)
    return hits.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.collect_list(kept).alias("spans"))


class Ledger:
    """An append-only Parquet table under `path`: one row for each blob and run that read it.

    A span carries the rule version that found it, so what a superseded version found is kept as history
    and never reported.
    """

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path, rules

    def rows(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(LEDGER).parquet(self.path) if there else self.spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (c.split(" ", 1) for c in LEDGER.split(", "))])

    def update(self, versions: DataFrame) -> None:
        """Scan what is new in versions(text): distinct blobs first, then unseen rule versions only.

        Copies meet as one row for each map task, so a hot blob is no hot key. A blob that every current
        rule version has read is dropped before any pattern looks at it.
        """
        keys = F.array(*[F.lit(r.key) for r in self.rules])
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        blobs = versions.select(address(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.any_value("text").alias("text"))
        seen = self.rows().select("blob", F.explode("scanned").alias("key")).groupBy("blob").agg(F.collect_set("key").alias("scanned"))
        todo = F.array_except(keys, F.coalesce("scanned", F.array().cast("array<string>")))
        new = blobs.join(seen, "blob", "left").select("blob", "text", todo.alias("todo")).where(F.size("todo") > 0)
        scan(new, self.rules).write.mode("append").parquet(self.path)

    def found(self) -> DataFrame:
        """FOUND's columns for each blob with a finding of the current rule versions.

        spans are by start, then by the order of the rules. pieces are the stretches of bytes outside all
        spans, one more than there are runs of overlapping spans; the last one's size reaches past any end.
        """
        keys, kinds = F.array(*[F.lit(r.key) for r in self.rules]), F.array(*[F.lit(r.kind) for r in self.rules])
        one = self.rows().where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).select("blob", "s.*", F.array_position(keys, F.col("s.rule")).cast("int").alias("ord")).where("ord > 0")
        one = one.dropDuplicates(["blob", "start", "ord"])
        upto = Window.partitionBy("blob").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, -1)
        reach = F.coalesce(F.max("last").over(upto), F.lit(0))
        one = one.withColumn("reach", reach)
        span = F.struct("start", (F.col("ord") - 1).alias("ord"), F.get(kinds, F.col("ord") - 1).alias("kind"), "end")
        gap = F.when((F.col("first") >= F.col("reach")), F.struct(F.col("reach").alias("first"), (F.col("first") - F.col("reach")).alias("size")))
        tail = F.array(F.struct(F.max("last").alias("first"), F.lit((1 << 31) - 1).alias("size")))
        return one.groupBy("blob").agg(F.array_sort(F.collect_list(span)).alias("spans"), F.concat(F.array_sort(F.collect_list(gap)), tail).alias("pieces"))

    def findings(self, versions: DataFrame) -> DataFrame:
        """versions(text, ...) with spans and pieces of their blob; both are null where nothing was found.

        Only blobs with findings take part. Up to BROADCAST_SPANS spans they are broadcast, so copies stay where
        they are; beyond that the rows of a blob are dealt over SALT keys.
        """
        names = {n: free_name(versions, n) for n in ("_blob", "_salt")}
        found = materialize(self.found(), "secret-findings")
        many = (found.agg(F.sum(F.size("spans"))).first()[0] or 0) > BROADCAST_SPANS
        blob = address(F.coalesce(F.col("text").cast("string"), F.lit("")))
        paths = versions.withColumn(names["_blob"], blob)
        held = found.select(F.col("blob").alias(names["_blob"]), F.struct("spans", "pieces").alias(free_name(versions, "_held")))
        keys = [names["_blob"]]
        if many:
            keys.append(names["_salt"])
            paths = paths.withColumn(names["_salt"], F.pmod(F.xxhash64(*[F.col(f"`{n}`") for n, t in versions.dtypes if "<" not in t and t != "variant"]), F.lit(SALT)).cast("int"))
            held = held.withColumn(names["_salt"], F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        return paths.join(held if many else F.broadcast(held), keys, "left").drop(*keys)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs(doc_id, text).

    Null text counts as empty. Repeated rows and copies each come back, though their blob is read once.
    Very long texts cost what their length and their matches cost. An empty table gives an empty result.
    Columns other than doc_id and text are not looked at. Without a ledger a new one is made, and removed.
    """
    docs, own_ledger = docs.select("doc_id", "text"), ledger is None
    ledger = ledger or Ledger(docs.sparkSession, scratch(docs.sparkSession, "secret-ledger"))
    ledger.update(docs)
    base = [r.kind for r in ledger.rules if r.base]
    spans = F.coalesce(F.col("_held.spans"), F.array().cast(SPANS))
    rows = ledger.findings(docs).select("doc_id", spans.alias("spans"))
    if own_ledger:
        forget(ledger)
    own = F.filter("spans", lambda s: s["kind"].isin(base))

    def of(kind: str):
        return F.filter("spans", lambda s: s["kind"] == kind)

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(joined(own).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redacted(text: Column, pieces: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by `mark`; bytes are cut where they lie."""
    raw = text.cast("binary")
    return F.array_join(F.transform(pieces, lambda p: F.substring(raw, p["first"] + 1, p["size"]).cast("string")), mark)


def redact(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """docs with secrets in `text` replaced; `n_chars`, where there is one, follows the new text.

    All rows and columns stay, whatever the columns are called. Null and empty texts stay as they are. An
    empty table gives an empty result. Blobs with findings are few and are joined by their address.
    """
    spark, own_ledger = docs.sparkSession, ledger is None
    ledger = ledger or Ledger(spark, scratch(spark, "secret-ledger"))
    ledger.update(docs.select("text"))
    names = docs.columns
    found = ledger.findings(docs)
    if own_ledger:
        forget(ledger)
    pieces = F.col(free_name(docs, "_held"))["pieces"]
    text = F.when(pieces.isNotNull(), redacted(F.col("text"), pieces)).otherwise(F.col("text"))
    cols = {"text": text} | ({"n_chars": F.when(pieces.isNotNull(), F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in names else {})
    return found.select(*[cols.get(n, F.col(f"`{n}`")).alias(n) for n in names])


def forget(ledger: Ledger) -> None:
    """Remove the ledger's folder."""
    remove(ledger.spark, ledger.path)
