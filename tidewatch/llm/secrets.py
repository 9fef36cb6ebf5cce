"""Secret scans over an incremental ledger of blobs.

Every historical version of a file is addressed by the SHA-256 of its text. The ledger has, for each blob, the rule versions
that have scanned it and the spans they found. A scan takes the pairs of blob and rule version that the ledger lacks, scans each
such blob once, appends the result and joins all findings back to every path that holds the blob. A changed rule gets a new
version and is run over old blobs alone; a new path with known text costs a join.

Null, repeated and odd input: a null text is empty; repeated rows and equal texts at several paths get the same findings each;
other columns are kept; an empty table gives no rows and leaves the ledger as it was. Texts are scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import documents
from tidewatch.session import shared_dir


class Rule(NamedTuple):
    """pattern: all leftmost non-overlapping matches count whose `group` has at least `least` characters.

    screen: an RE2 pattern that every text with such a match has a match of.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    screen: str

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order of their kinds, as first released.
RULES = (
    Rule("assign", 1, r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8,
         r"""(?i)(?:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[a-z0-9+/_.=-]{8}"""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.eyJ"),
)
#: Between the lines of a key: white space, also escaped, and the marks of quotes, comments and string literals.
_BREAK = r"""(?:[\s>#*|"',;]|\\[rn])"""
_KEY = (r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----"
        r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"  # no second key may begin before the END line
        rf"|(?:{_BREAK}+(?:Proc-Type|DEK-Info|Comment|Version):[^\r\n\\]*)*"
        rf"(?:(?:{_BREAK}+[A-Za-z0-9+/]{{16,}}={{0,2}})+"
        rf"(?:{_BREAK}+[A-Za-z0-9+/]+={{0,2}}(?=[\x20\t]*(?:[\r\n\\\"']|\Z)))?)?)")
#: The newest version of each rule: a private key reaches to its END line, or to the end of its base64 block where that is missing.
CURRENT = tuple(Rule("private_key", 2, _KEY, 0, 1, r.screen) if r.kind == "private_key" else r for r in RULES)
#: All versions that a ledger may hold.
EVERY = RULES + tuple(r for r in CURRENT if r not in RULES)
#: Kinds whose spans the base digest covers.
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rules array<string>, spans array<struct<rule:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(text: str, rule: Rule) -> list[tuple[int, int]]:
    """Spans of the rule in the text, in code points, end exclusive."""
    return [m.span() for m in re.finditer(rule.pattern, text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan(rules: tuple[Rule, ...]):
    by_key = {r.key: r for r in rules}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, todo = b.column("text"), b.column("todo").to_pylist()
            spans: list[list[dict]] = [[] for _ in todo]
            for rule in by_key.values():
                for i in pc.indices_nonzero(pc.match_substring_regex(text, rule.screen)).to_pylist():
                    if rule.key in todo[i]:
                        spans[i] += [{"rule": rule.key, "start": s, "end": e} for s, e in find(text[i].as_py(), rule)]
            yield pa.RecordBatch.from_arrays([b.column("blob"), b.column("todo"), pa.array(spans, _SPANS)], ["blob", "rules", "spans"])

    return run


def _known(spark: SparkSession, ledger: str) -> DataFrame | None:
    from py4j.protocol import Py4JError

    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    except Py4JError as e:
        raise ValueError(f"the ledger's folder cannot be read: {ledger}") from e
    return spark.read.schema(LEDGER).parquet(ledger) if there else None


def with_blob(versions: DataFrame) -> DataFrame:
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = CURRENT) -> None:
    """Scan the blobs of `versions` (rows with a text) that some rule version has not seen, and append to the ledger.

    Copies of a text are reduced to one before the shuffle and after it, so a text that a third of all rows share is one row
    per task. When the ledger has rows, hashes alone decide which texts move.
    """
    keys = F.array(*(F.lit(r.key) for r in rules))
    texts = with_blob(versions.select("text")).select("blob", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = _known(versions.sparkSession, ledger)
    if known is None:
        unseen = texts.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", keys)
    else:
        done = known.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))  # a set per rule change
        todo = texts.select("blob").distinct().join(done, "blob", "left").select(
            "blob", F.array_except(keys, F.coalesce("done", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        unseen = texts.join(todo, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    unseen.mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = EVERY) -> DataFrame:
    """blob, spans (rule, start, end) of the blobs in which the given rule versions found something.

    A blob that two runs appended is one row, each span once.
    """
    keys = [r.key for r in rules]
    rows = spark.read.schema(LEDGER).parquet(ledger).where(F.size("spans") > 0)
    merged = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return merged.select("blob", F.filter("spans", lambda s: s["rule"].isin(keys)).alias("spans")).where(F.size("spans") > 0)


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = CURRENT) -> DataFrame:
    """`versions` without its text, with blob and spans (empty when nothing was found), after bringing the ledger up to date.

    Columns of these two names in `versions` are replaced.
    """
    versions = versions.drop("blob", "spans")
    update_ledger(versions, ledger, rules)
    found = findings(versions.sparkSession, ledger, rules)
    none = F.array().cast("array<struct<rule:string,start:int,end:int>>")
    return with_blob(versions).drop("text").join(found, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def ordered_spans(spans: Column, rules: tuple[Rule, ...] = CURRENT) -> Column:
    """Spans as (start, kind's place, end, kind), sorted."""
    place = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)))

    def shaped(s: Column) -> Column:
        kind = F.element_at(F.split(s["rule"], "@"), 1)
        return F.struct(s["start"].alias("start"), F.element_at(place, kind).alias("place"), s["end"].alias("end"), kind.alias("kind"))

    return F.array_sort(F.transform(spans, shaped))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: str, mask: str = "[secret]", rules: tuple[Rule, ...] = CURRENT) -> DataFrame:
    """The documents with every found span replaced by `mask`; spans that overlap are replaced as one."""
    update_ledger(docs, ledger, rules)
    found = findings(docs.sparkSession, ledger, rules)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
    joined = with_blob(whole).join(found, "blob", "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mask)).alias("out")))

    spans = ordered_spans(F.col("spans"), rules)
    cleaned = F.aggregate(spans, start, cut, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cleaned)
    return joined.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_versions(documents(spark, sf_dir).select("doc_id", "text"), shared_dir(spark, "ledger"))
    spans = ordered_spans(F.col("spans"))
    base = F.filter(spans, lambda s: s["kind"].isin(list(BASE)))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *map(count, BASE), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(spans).alias("spans"))
