"""Readers: JSON shapes, event XML, flow CSV, rule files, bundles, raw Windows records, text corpora."""

from __future__ import annotations

from collections.abc import Iterator

from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.text import nz
from tidewatch.operators.scoring import auto_label, collector_suspicious
from tidewatch.rules import attack as A
from tidewatch.rules import detection as D
from tidewatch.sources import normalize as N


# ---------------------------------------------------------------- JSON
def read_events_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Event batch files: an array or a single object per file (multi_line), or one object per line. A missing
    timestamp becomes the read time."""
    df = spark.read.schema(schema).json(path, multiLine=multi_line, mode="DROPMALFORMED")
    return df.withColumn("timestamp", F.coalesce(F.col("timestamp"), F.date_format(
        F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))) if "timestamp" in df.columns else df


def stream_events_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def read_wrapped_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files holding an array, one object (on one line or many), lines, or {"data": …} / {"events": …} wrappers around an
    array or one object; compressed too. Adds source_file.

    A file whose first line is a whole object is read line by line, and bad lines fall out; any other is one document.
    """
    lines = spark.read.text(path, recursiveFileLookup=True, wholetext=True).select(
        F.col("value"), F.input_file_name().alias("source_file"))
    inner = f"struct<{_as_struct(schema)}>"
    doc = F.btrim("value", F.lit(" \t\r\n"))
    array_doc = F.from_json(doc, f"array<{inner}>")
    wrapped = F.from_json(doc, f"struct<data:array<{inner}>,events:array<{inner}>>")
    is_wrapped = wrapped["data"].isNotNull() | wrapped["events"].isNotNull()
    single = F.from_json(doc, f"struct<data:{inner},events:{inner}>")
    one = F.coalesce(*(F.when(F.get_json_object(doc, f"$.{k}").startswith("{"), single[k]) for k in ("data", "events")))
    whole = F.from_json(doc, inner)
    first_line = F.element_at(F.split(doc, "\n"), 1)
    by_line = F.json_object_keys(first_line).isNotNull() & F.contains(doc, F.lit("\n"))
    per_line = F.filter(F.transform(F.filter(F.split("value", "\n"), lambda s: F.trim(s) != ""),
                                    lambda s: F.from_json(s, schema, {"mode": "PERMISSIVE"})),
                        lambda r: F.to_json(r) != "{}")
    rows = (F.when(F.startswith(doc, F.lit("[")), array_doc)
            .when(by_line, per_line).when(is_wrapped, F.coalesce(wrapped["data"], wrapped["events"]))
            .when(one.isNotNull(), F.array(one)).when(F.json_object_keys(doc).isNotNull(), F.array(whole)).otherwise(per_line))
    return lines.select("source_file", F.explode(rows).alias("r")).select("source_file", "r.*")


def _as_struct(schema: str) -> str:
    """'a string, b int' -> 'a:string,b:int'."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString()[len("struct<"):-1]


def read_log_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line; lines that do not parse are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def read_parallel_labels(spark: SparkSession, events_path: str, labels_path: str, schema: str,
                         pair: Column | None = None) -> DataFrame:
    """Events and labels kept as two JSON arrays, joined by position inside each pair of files.

    Files pair by `pair`, an expression of the file name; by default the name's part before the last underscore
    (train_events.json, train_labels.json). A pair whose arrays
    differ in length, or a file without its partner, is an error: labels of the wrong events are worse than none.
    """
    from pyspark.sql.types import StructType

    inner = StructType.fromDDL(schema).simpleString()
    stem = F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:_[^/_]*)?$", 1) if pair is None else pair

    def load(path: str, kind: str, size: str) -> DataFrame:
        files = spark.read.text(path, wholetext=True).select(stem.alias("pair"), F.from_json("value", f"array<{kind}>").alias("a"))
        return files.select("pair", F.size("a").alias(size), "a")

    events, labels = load(events_path, inner, "n_events"), load(labels_path, "string", "n_labels")
    if all(len(x.select("pair").take(2)) == 1 for x in (events, labels)):  # two single files pair whatever their names
        events, labels = (x.withColumn("pair", F.lit("")) for x in (events, labels))
    pairs = events.withColumnRenamed("a", "e").join(labels.withColumnRenamed("a", "l"), "pair", "full_outer")
    fits = F.coalesce(F.col("n_events") == F.col("n_labels"), F.lit(False))
    said = F.concat(F.lit("events and labels differ in number: "), F.col("pair"), F.lit(" "), F.coalesce("n_events", F.lit(0)).cast("string"),
                    F.lit(" and "), F.coalesce("n_labels", F.lit(0)).cast("string"))
    rows = pairs.select("pair", F.when(fits, F.arrays_zip("e", "l")).otherwise(F.raise_error(said)).alias("z"))
    return rows.select(F.posexplode("z").alias("pos", "r")).select("pos", "r.e.*", F.col("r.l").alias("label"))


# ---------------------------------------------------------------- event XML
XML_SCHEMA = ("System struct<EventID:string, Computer:string, Channel:string, TimeCreated:struct<_SystemTime:string>>, "
              "EventData struct<Data:array<struct<_VALUE:string,_Name:string>>>")


def parse_event_xml(lines: DataFrame, column: str = "value", label: int | None = 1) -> DataFrame:
    """One <Event> per line to EventID, Computer, Channel, time and the EventData map."""
    rows = lines.where(F.startswith(F.trim(column), F.lit("<Event")))
    parsed = rows.withColumn("x", F.from_xml(F.trim(column), XML_SCHEMA, {"rowTag": "Event"}))
    named = F.filter("x.EventData.Data", lambda d: d["_Name"].isNotNull() & (nz(d["_VALUE"]) != ""))
    pairs = F.transform(named, lambda d: F.struct(d["_Name"].alias("k"), F.trim(d["_VALUE"]).alias("v")))
    data = F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))
    return parsed.where(F.col("x").isNotNull()).select(
        *[c for c in lines.columns if c != column], F.col("x.System.EventID").try_cast("int").alias("EventID"),
        F.col("x.System.Computer").alias("Computer"), F.col("x.System.Channel").alias("Channel"),
        F.col("x.System.TimeCreated._SystemTime").alias("TimeCreated"), data.alias("data"),
        F.lit(label).cast("int").alias("label"))


def read_event_xml(spark: SparkSession, path: str, label: int | None = 1) -> DataFrame:
    lines = spark.read.text(path).select("value", F.input_file_name().alias("source_file"))
    return parse_event_xml(lines, label=label)


# ---------------------------------------------------------------- CSV
def read_flow_csv(spark: SparkSession, path: str, dialect: str = "a", sep: str | None = None, limit: int | None = None) -> DataFrame:
    """Flow CSV files with a header each; adds source_file. The row cap is the reader's own option and off by default.

    Files may differ in columns and delimiter: the first line of each tells both (the one of comma and semicolon that it has
    more of, when `sep` is not given), and files that agree are read together.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    heads = lines.where("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")).groupBy("file").agg(
        F.min_by("value", "at").alias("head"))
    groups: dict[tuple[str, str], list[str]] = {}
    for r in heads.orderBy("file").toLocalIterator():  # a row per file, as the driver's own file listing
        head = (r.head or "").lstrip("\ufeff")
        groups.setdefault((sep or (";" if head.count(";") >= head.count(",") and ";" in head else ","), head), []).append(r.file)
    out = None
    for (mark, _), files in groups.items():
        raw = spark.read.option("header", True).option("sep", mark).csv([unquote(f) for f in files])
        part = raw.withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        part = N.flow_a(part, ("source_file",)) if dialect == "a" else N.flow_b(part, ("source_file",))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no flow files at {path}")
    return out.limit(limit) if limit else out


ATTACK_CSV_SCHEMA = ("EVTX_Tactic string, EVTX_FileName string, EventID string, Channel string, Computer string, "
                     "ProcessName string, Image string, CommandLine string, ParentImage string, LogonType string, "
                     "SubjectUserName string, TargetUserName string, DestinationPort string")


def read_attack_csv(spark: SparkSession, path: str, schema: str = ATTACK_CSV_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


# ---------------------------------------------------------------- data set load
def load_sources(named: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """{file name: (normaliser, raw)} to one unified table with auto labels where none is given; adds source_file."""
    out = None
    for name, (kind, raw) in named.items():
        part = N.NORMALISERS[kind](raw)
        labelled = auto_label(part)
        part = labelled.withColumns({
            "label_source": F.coalesce(F.when(F.col("label").isNotNull(), F.col("label_source")), F.col("auto_reason")),
            "label": F.coalesce("label", "auto_label")}).drop("auto_label", "auto_reason").withColumn(
            "source_file", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def concat_sources(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------- technique bundle
BUNDLE_SCHEMA = (
    "objects array<struct<type:string,name:string,description:string,revoked:boolean,x_mitre_deprecated:boolean,"
    "x_mitre_platforms:array<string>,x_mitre_detection:string,x_mitre_aliases:array<string>,"
    "external_references:array<struct<source_name:string,external_id:string>>,"
    "kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUNDLE_SCHEMA).json(path, multiLine=True).select(F.explode("objects").alias("o")).select(
        "o.*")


def technique_keywords(name: Column, detection: Column, aliases: Column) -> Column:
    """Name words over 3 letters, alphabetic detection words over 5, aliases; sorted, distinct, ten at most."""
    words = F.filter(F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) > 3)
    hints = F.filter(F.transform(F.split(nz(detection), r"\s+"), lambda w: F.regexp_replace(
        F.lower(w), "^[.,;:]+|[.,;:]+$", "")), lambda w: (F.length(w) > 5) & w.rlike("^[a-z]+$"))
    also = F.transform(F.coalesce(aliases, F.array().cast("array<string>")), F.lower)
    return F.slice(F.array_sort(F.array_distinct(F.concat(words, hints, also))), 1, 10)


def build_catalogue(objects: DataFrame) -> DataFrame:
    """Bundle objects to (id, name, tactic, all_tactics, keywords, severity, description, is_subtechnique)."""
    refs = F.filter("external_references", lambda r: (r["source_name"] == "mitre-attack") & F.startswith(
        r["external_id"], F.lit("T")))
    platforms = F.transform(F.coalesce("x_mitre_platforms", F.array().cast("array<string>")), F.lower)
    tactics = F.array_compact(F.transform(
        F.filter("kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"),
        lambda p: F.when(p["phase_name"].isin(list(A.TACTIC_KEYS)), F.replace(p["phase_name"], F.lit("-"), F.lit("_")))))
    live = ((F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False))
            & ~F.coalesce("x_mitre_deprecated", F.lit(False)))
    rows = objects.where(live).select(
        F.get(refs, F.lit(0))["external_id"].alias("id"), "name", tactics.alias("all_tactics"),
        technique_keywords(F.col("name"), F.col("x_mitre_detection"), F.col("x_mitre_aliases")).alias("keywords"),
        F.substring(nz("description"), 1, 200).alias("description"), platforms.alias("_p"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("all_tactics") > 0) & (
        (F.size("_p") == 0) | F.arrays_overlap("_p", F.array(*[F.lit(p) for p in A.WINDOWS_PLATFORMS])))).drop("_p")
    severity = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in A.TACTIC_SEVERITY.items() for x in kv]),
                                       F.col("all_tactics")[0]), F.lit(50))
    return rows.withColumns({"tactic": F.col("all_tactics")[0], "severity": severity,
                             "is_subtechnique": F.contains("id", F.lit("."))})


def techniques_per_tactic(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("tactic").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- rule files
RULE_SCHEMA = ("level string, status string, field string, pattern string, rule_id string, title string, "
               "mitre array<string>")


def flatten_rule_documents(text: str) -> list[tuple]:
    """YAML text (several documents allowed) to (level, status, field, pattern, id, title, tags)."""
    import yaml

    rows = []
    try:
        docs = [d for d in yaml.safe_load_all(text) if isinstance(d, dict) and "detection" in d]
    except yaml.YAMLError:
        return rows
    for doc in docs:
        tags = [t for t in doc.get("tags") or [] if str(t).startswith("attack.")]
        todo = [("", doc["detection"])]
        while todo:
            field, node = todo.pop(0)
            if isinstance(node, dict):
                todo[:0] = [(str(k).lower(), v) for k, v in node.items() if k not in ("condition", "timeframe")]
            elif isinstance(node, list):
                todo[:0] = [(field, v) for v in node]
            elif isinstance(node, str) and field and node:
                rows.append((doc.get("level", "medium"), doc.get("status", "experimental"), field,
                             node.replace("*", ".*"), str(doc.get("id", "")), str(doc.get("title", "")), tags))
    return rows


def parse_rules(files: DataFrame, column: str = "value") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["level", "status", "field", "pattern", "rule_id", "title", "mitre"]
        for b in batches:
            yield pd.DataFrame([r for t in b[column] for r in flatten_rule_documents(t)], columns=names)

    return files.select(column).mapInPandas(run, RULE_SCHEMA)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yml,yaml}")
    return parse_rules(files)


def rule_statistics(patterns: DataFrame) -> DataFrame:
    rules = patterns.select("rule_id", "level", "status").distinct()
    return rules.groupBy("level", "status").agg(F.count(F.lit(1)).alias("rules"))


# ---------------------------------------------------------------- text corpora and stored tables
def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    from tidewatch.operators.knowledge import title_from_path

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{txt,md}")
    src = F.input_file_name()
    return files.select(src.alias("source"), title_from_path(src).alias("title"), F.col("value").alias("text"))


def stored(df: DataFrame, newest: str | None = None, limit: int | None = None, **equals: str) -> DataFrame:
    """Filter by equality, newest first, limited: the stored-table reads."""
    for c, v in equals.items():
        df = df.where(F.col(c) == v)
    if newest:
        df = df.orderBy(F.desc(newest))
    return df.limit(limit) if limit else df


# ---------------------------------------------------------------- raw Windows records
def raw_windows_record(df: DataFrame, channel: str = "channel", keep: tuple[str, ...] = ()) -> DataFrame:
    """EventID (low 16 bits) and positional inserts to named fields, by event id; `StringInserts` is an array."""
    eid = F.col("EventID").bitwiseAND(0xFFFF)
    s = lambda i, default="": F.coalesce(F.get("StringInserts", F.lit(i)), F.lit(default))
    user_actions = {4720: "user_created", 4722: "user_enabled", 4725: "user_disabled", 4726: "user_deleted"}
    ua = F
    for k, v in user_actions.items():
        ua = ua.when(eid == k, v)
    ua = ua.otherwise("user_change")
    change = eid.isin(list(user_actions))
    rest = F.concat_ws(" | ", F.filter(F.slice("StringInserts", 1, 3), lambda x: nz(x) != ""))
    cases = lambda *pairs: _first(eid, pairs)
    out = df.select(
        *keep, eid.alias("event_id"), F.col(channel).alias("channel"),
        cases((4688, F.lit("process_creation")), (4624, F.lit("logon_success")), (4625, F.lit("logon_failure")),
              (4104, F.lit("powershell_execution")), (7045, F.lit("service_installed")),
              (None, F.when(change, ua))).alias("action"),
        cases((4688, s(1, "SYSTEM")), (4624, s(5)), (4625, s(5)), (4104, s(1)), (None, F.when(change, s(0)))).alias(
            "user"),
        cases((4688, s(5))).alias("process_name"), cases((4688, s(4))).alias("process_id"),
        cases((4688, s(8))).alias("command_line"), cases((4688, s(13))).alias("parent_process"),
        cases((4624, s(8))).alias("logon_type"), cases((4624, s(18)), (4625, s(19))).alias("source_ip"),
        cases((4625, s(10))).alias("failure_reason"), cases((4104, F.substring(s(2), 1, 1000))).alias(
            "script_block_text"),
        cases((7045, s(0))).alias("service_name"), cases((7045, s(1))).alias("service_file"),
        cases((None, F.when(change, s(4)))).alias("target_user"),
        cases((4688, F.concat(F.lit("Process: "), s(5))), (4624, F.concat(F.lit("Logon: "), s(5))),
              (4625, F.concat(F.lit("Failed logon: "), s(5))), (4104, F.lit("PowerShell script executed")),
              (7045, F.concat(F.lit("Service: "), s(0))),
              (None, F.when(change, F.concat(F.lit("User: "), ua)).otherwise(rest))).alias("message"))
    return out.withColumn("suspicious", collector_suspicious())


def _first(eid: Column, pairs) -> Column:
    out, default = F, F.lit(None).cast("string")
    for k, v in pairs:
        if k is None:
            default = v
        else:
            out = out.when(eid == k, v)
    return out.otherwise(default) if out is not F else default


def allowed_events(df: DataFrame) -> DataFrame:
    """Keep (channel, event_id) pairs on the fixed list and add their severity; suspicious rows become warnings."""
    keep, sev = F.lit(False), F
    for ch, ids in D.CHANNEL_ALLOW.items():
        keep = keep | ((F.col("channel") == ch) & F.col("event_id").isin(ids))
    for (ch, eid), level in D.CHANNEL_SEVERITY.items():
        sev = sev.when((F.col("channel") == ch) & (F.col("event_id") == eid), level)
    base = sev.otherwise("info")
    if "suspicious" in df.columns:
        base = F.when(F.col("suspicious"), "warning").otherwise(base)
    return df.where(keep).withColumn("severity", base)


def newer_than(df: DataFrame, seen: DataFrame, key: str, record_no: str) -> DataFrame:
    """Rows above the last record number seen per key; a stream source does the same with its checkpoint."""
    last = seen.groupBy(key).agg(F.max(record_no).alias("_last"))
    return df.join(last, key, "left").where(F.col("_last").isNull() | (F.col(record_no) > F.col("_last"))).drop("_last")


