"""Rule matching. Fixed catalogues are expressions evaluated in the scan stage: no join, no row explosion before the
match is known. Catalogues that come as tables are matched in checked blocks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.ioc import indicator_type
from tidewatch.functions.text import has, has_any, low, nz, pin, safe_int, search
from tidewatch.operators.ordered import join_grown, top_per_key
from tidewatch.rules import attack as A
from tidewatch.rules import intel as I
from tidewatch.rules import labels as L


# ---------------------------------------------------------------- shared texts
STAGE = "_m_"


def _texts() -> dict[str, Column]:
    join = lambda *cs: F.concat_ws(" ", *[F.when(nz(c) != "", nz(c)) for c in cs])
    return {"cmd": low("command_line"), "proc": low("process_name"), "parent": low("parent_image"),
            "kw": F.lower(join("command_line", "process_name", "script_block_text", "action")),
            "phase": F.lower(F.concat_ws(" ", nz("process_name"), nz("command_line"), nz("action"))),
            "ioc": join(*IOC_FIELDS)}


IOC_FIELDS = ["command_line", "script_block_text", "message", "service_file", "source_ip", "destination_ip",
              "query_name", "image_loaded"]


def stage_texts(df: DataFrame, *names: str) -> DataFrame:
    """Compute the texts the rules search once per row; the rules then read them with staged=True. Without this every
    rule would build its text again, as conditional branches share nothing."""
    texts = _texts()
    return df.withColumns({STAGE + n: pin(texts[n]) for n in (names or texts)})


def text_of(name: str, staged: bool) -> Column:
    return F.col(STAGE + name) if staged else _texts()[name]


def drop_texts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(STAGE)])


# ---------------------------------------------------------------- keyword techniques
def keyword_techniques(staged: bool = False) -> Column:
    """array<struct<rule_order, id, name, tactic>>: techniques whose keyword occurs or equals the event id."""
    text = text_of("kw", staged)
    eid = nz("event_id")
    by_id: dict[str, list[tuple[int, str, str, str]]] = {}
    for i, (word, tid, name, tactic) in enumerate(A.KEYWORD_TECHNIQUES):
        by_id.setdefault(tid, []).append((i, word, name, tactic))
    hits = []
    for tid, rules in by_id.items():
        best = F
        for i, word, name, tactic in rules:
            cond = has(text, word) if not word.isdigit() else has(text, word) | (eid == word)
            best = best.when(cond, F.struct(F.lit(i).alias("rule_order"), F.lit(tid).alias("id"),
                                            F.lit(name).alias("name"), F.lit(tactic).alias("tactic")))
        hits.append(best)
    return F.array_sort(F.array_compact(F.array(*hits)))


# ---------------------------------------------------------------- pattern techniques
def pattern_techniques(staged: bool = False) -> Column:
    """array<struct<rule_order, id, name, tactic, confidence, evidence>> with additive confidence, floor 0.3, cap 1."""
    cmd, proc, parent = (text_of(n, staged) for n in ("cmd", "proc", "parent"))
    eid, logon, port = safe_int("event_id"), safe_int("logon_type"), safe_int("destination_port")
    w = A.EVIDENCE_WEIGHT
    out = []
    for order, t in enumerate(A.PATTERN_TECHNIQUES):
        rows: list[tuple[Column, float, Column | None]] = []
        if t.get("event_ids"):
            rows.append((eid.isin(t["event_ids"]), w["event_id"], None))
        rows += [(_match(cmd, p), w["pattern"], F.lit(f"Pattern match: {p}")) for p in t.get("patterns", [])]
        rows += [(has(proc, p), w["process"], F.lit(f"Process: {p}")) for p in t.get("processes", [])]
        rows += [(has(parent, p), w["parent"], F.lit(f"Parent: {p}")) for p in t.get("parents", [])]
        if t.get("logon_types"):
            rows.append((logon.isin(t["logon_types"]), w["logon_type"],
                         F.concat(F.lit("Logon type: "), logon.cast("string"))))
        if t.get("ports"):
            rows.append((port.isin(t["ports"]), w["port"], F.concat(F.lit("Port: "), port.cast("string"))))
        total = F.lit(0.0)
        for cond, weight, _ in rows:
            total = total + F.when(cond, weight).otherwise(0.0)
        evidence = F.array_compact(F.array(*[F.when(c, e) for c, _, e in rows if e is not None]))
        out.append(F.when(total >= A.EVIDENCE_FLOOR, F.struct(
            F.lit(order).alias("rule_order"), F.lit(t["id"]).alias("id"), F.lit(t["name"]).alias("name"),
            F.lit(t["tactic"]).alias("tactic"), F.least(total, F.lit(1.0)).alias("confidence"),
            evidence.alias("evidence"))))
    return F.array_compact(F.array(*out))


def _match(text: Column, pattern: str) -> Column:
    """Plain words are substring tests; other patterns run as a regex behind a substring test of their longest word."""
    if re.fullmatch(r"[a-z0-9 -]+", pattern):
        return has(text, pattern)
    words = re.findall(r"[a-z0-9 -]{2,}", re.sub(r"\\.", "\x00", pattern))
    return has(text, max(words, key=len)) & search(text, pattern) if words else search(text, pattern)


def explode_techniques(df: DataFrame, techniques: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(techniques).alias("_t")).select(*keep, "_t.*")


# ---------------------------------------------------------------- table-driven catalogues
MAX_BLOCK = 2000


def _blocks(rules: DataFrame, columns: list[str]):
    """The rule table in blocks of at most MAX_BLOCK rows, streamed through the driver one block at a time."""
    block = []
    for row in rules.select(*columns).toLocalIterator():
        block.append(tuple(row))
        if len(block) == MAX_BLOCK:
            yield block
            block = []
    if block:
        yield block


#: Keywords shorter than this are no evidence, so every keyword holds a run of this many characters.
GRAM = 4
#: Copies of a frequent text's matches, so that events that share one text meet them in several tasks; how many texts are copied.
TEXT_SALTS, HOT_TEXTS = 16, 200


def _grams(text: Column) -> Column:
    """All runs of GRAM characters, each once; a look-ahead finds overlapping ones in one pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def keyword_index(catalogue: DataFrame) -> DataFrame:
    """Inverted index (gram, keyword, id, name, tactic, times) of a catalogue (id, name, tactic, keywords).

    A keyword stands under one gram only, the one that the fewest keywords share, so a text finds it at most once.
    """
    words = catalogue.select("id", "name", "tactic", F.explode("keywords").alias("keyword")).where(
        F.length("keyword") >= GRAM).groupBy("id", "name", "tactic", "keyword").agg(F.count(F.lit(1)).alias("times"))
    grams = words.select("keyword").distinct().select("keyword", F.explode(_grams(F.col("keyword"))).alias("gram"))
    common = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    anchor = grams.join(common, "gram").groupBy("keyword").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return anchor.join(words, "keyword")


def extended_text() -> Column:
    return F.concat_ws(" ", low("command_line"), low("process_name"), low("script_block_text"))


def text_techniques(texts: DataFrame, index: DataFrame, limit: int = 10, text: str = "_text", key: str = "_text_key") -> DataFrame:
    """(key, extended): the techniques with at least two keyword hits in each distinct text, confidence hits/5, best first.

    Grams of distinct texts meet the index in an equi-join, and only keywords whose gram occurs are searched for.
    """
    # a row per keyword of the rules, which do not grow with the events; the texts' grams would be shuffled, or broadcast
    found = texts.select(key, text, F.explode(_grams(F.col(text))).alias("gram")).join(F.broadcast(index), "gram").where(
        F.contains(F.col(text), F.col("keyword")))
    hits = found.groupBy(key, "id", "name", "tactic").agg(F.sum("times").alias("hits")).where("hits >= 2")
    ranked = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        (-F.least(F.col("hits") / 5.0, F.lit(1.0))).alias("minus"), "id", "name", "tactic"))).alias("all"))
    return ranked.select(key, F.transform(F.slice("all", 1, limit), lambda t: F.struct(
        t["id"].alias("id"), t["name"].alias("name"), t["tactic"].alias("tactic"), (-t["minus"]).alias("confidence"))).alias("extended"))


def with_extended(events: DataFrame, catalogue: DataFrame, limit: int = 10, how: str = "left", key: str = "event_key") -> DataFrame:
    """Events with their array `extended` (null where nothing matches). A text that many events share is matched once, and
    the matches of the HOT_TEXTS most frequent are copied TEXT_SALTS times before they meet the events."""
    staged = events.withColumn("_text", pin(extended_text())).withColumn("_text_key", F.md5("_text"))
    distinct = staged.select("_text_key", "_text").dropDuplicates(["_text_key"])
    found = text_techniques(distinct, keyword_index(catalogue), limit)
    often = staged.groupBy("_text_key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_text_key").limit(HOT_TEXTS)
    hot = F.col("_text_key").isin([r["_text_key"] for r in often.collect()])
    copies = found.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(TEXT_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    salted = staged.withColumn("_salt", F.when(hot, F.pmod(F.xxhash64(key), F.lit(TEXT_SALTS)).cast("int")).otherwise(0))
    return join_grown(salted, copies, ["_text_key", "_salt"], how).drop("_text", "_text_key", "_salt")


def extended_techniques(events: DataFrame, catalogue: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """(key, id, name, tactic, confidence) for events with at least two keyword hits; confidence is hits/5."""
    texts = events.select(key, "command_line", "process_name", "script_block_text")
    return with_extended(texts, catalogue, limit, "inner", key).select(key, F.explode("extended").alias("t")).select(key, "t.*")


EXTENDED_EVIDENCE = "keyword match (extended MITRE)"


def merged_techniques(matched: Column, extended: Column) -> Column:
    """Pattern techniques and those extended ones whose id is not among them, by confidence; equals keep their order.

    The difference on technique id is taken inside the row: no join. Confidences that differ by rounding only are equal.
    """
    ids = F.transform(matched, lambda t: t["id"])
    fresh = F.filter(F.coalesce(extended, F.array().cast("array<struct<id:string,name:string,tactic:string,confidence:double>>")),
                     lambda t: ~F.array_contains(ids, t["id"]))
    numbered = F.concat(
        F.transform(matched, lambda t, i: F.struct((-F.round(t["confidence"], 6)).alias("minus"), i.alias("place"), t["id"].alias("id"),
                                                   t["name"].alias("name"), t["tactic"].alias("tactic"), t["confidence"].alias("confidence"),
                                                   t["evidence"].alias("evidence"), F.lit(False).alias("extended"))),
        F.transform(fresh, lambda t, i: F.struct((-F.round(t["confidence"], 6)).alias("minus"), (i + 1000).alias("place"), t["id"].alias("id"),
                                                 t["name"].alias("name"), t["tactic"].alias("tactic"), t["confidence"].alias("confidence"),
                                                 F.array(F.lit(EXTENDED_EVIDENCE)).alias("evidence"), F.lit(True).alias("extended"))))
    return F.transform(F.array_sort(numbered), lambda t: F.struct(
        t["id"].alias("id"), t["name"].alias("name"), t["tactic"].alias("tactic"), t["confidence"].alias("confidence"),
        t["evidence"].alias("evidence"), t["extended"].alias("extended")))


def _java_pattern(spark: SparkSession, pattern: str) -> str | None:
    """The pattern as Java reads it, or None when it is no pattern. Braces that repeat nothing are literal, and {,n} is
    {0,n}, as in the rule files' own dialect."""
    from py4j.protocol import Py4JJavaError

    try:
        re.compile(pattern)
    except re.error:
        return None
    pattern = re.sub(r"(?<!\\)\{,(\d+)\}", r"{0,\1}", pattern)
    pattern = re.sub(r"(?<!\\)\{(?!\d+(?:,\d*)?\})", r"\\{", pattern)
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Py4JJavaError:
        return None
    return pattern


def sigma_class(patterns: DataFrame) -> Column:
    """Class of the highest level with any matching pattern; null when none.

    Patterns are checked on the driver with the engine that runs them: those that do not compile there count as plain
    substrings, and so do those that are no pattern to begin with. One alternation per level keeps the row work to at most
    four searches per block.
    """
    text = F.concat_ws(" ", low("command_line"), low("process_name"), low("parent_image"))
    per_level: dict[str, list[Column]] = {lv: [] for lv in L.LEVEL_ORDER}
    for block in _blocks(patterns.where(F.col("level").isin(L.LEVEL_ORDER)).select("level", "pattern").distinct(),
                         ["level", "pattern"]):
        regexes: dict[str, list[str]] = {lv: [] for lv in L.LEVEL_ORDER}
        for level, pattern in block:
            p = pattern.lower()
            if (regex := _java_pattern(patterns.sparkSession, p)) is not None:
                regexes[level].append(f"(?:{regex})")
            else:
                per_level[level].append(has(text, p))
        for level, ps in regexes.items():
            if ps:
                per_level[level].append(search(text, "(?i)" + "|".join(ps)))
    out = F
    for level in L.LEVEL_ORDER:
        for cond in per_level[level]:
            out = out.when(cond, L.LEVEL_CLASS[level])
    return out.otherwise(None) if any(per_level.values()) else F.lit(None).cast("string")


# ---------------------------------------------------------------- scenario tags
def scenario_tags() -> Column:
    """array<string> of technique ids tagged on an event."""
    text = F.concat(low("command_line"), F.lit(" "), low("process_name"))
    eid = safe_int("event_id")
    hits = []
    for tid, words, ids in A.SCENARIO_TAGS:
        cond = has_any(text, words)
        hits.append(F.when(cond | eid.isin(ids) if ids else cond, F.lit(tid)))
    return F.array_compact(F.array(*hits))


# ---------------------------------------------------------------- indicators against intel
def local_intel(indicators: DataFrame) -> DataFrame:
    """(value, type) rows with local verdict and details. The offline table is a fixed dozen entries, so it is an
    expression; a real feed goes through `intel_join`."""
    v, low_v, kind = F.col("value"), F.lower("value"), F.col("type")
    cases = F
    for t, bad, details in I.LOCAL_INTEL:
        cases = cases.when(F.startswith(kind, F.lit(t)) & ((v if t == "ip" else low_v) == bad), details)
    for word, details in I.LOCAL_PROCESSES:
        cases = cases.when((kind == "process") & has(low_v, word), details)
    return indicators.withColumn("details", cases.otherwise(I.NOT_LISTED)).withColumn(
        "is_malicious", F.col("details") != I.NOT_LISTED)


def intel_join(indicators: DataFrame, feed: DataFrame) -> DataFrame:
    """Distinct indicators against an intel feed (type, value, …): equi-join, strategy left to the planner."""
    return indicators.select("type", "value").distinct().join(feed, ["type", "value"], "left")


def provider_verdict(results: DataFrame) -> DataFrame:
    """Provider rows (indicator, provider, malicious_votes, total_engines, abuse_confidence_score, is_malicious) to one
    verdict per indicator: any malicious, and the weighted mean of the providers' confidences."""
    p = F.col("provider")
    weight, conf = F, F
    total = F.when(F.coalesce(F.col("total_engines"), F.lit(1)) == 0, 1).otherwise(
        F.coalesce(F.col("total_engines"), F.lit(1)))
    ratios = {"VirusTotal": F.coalesce(F.col("malicious_votes"), F.lit(0)) / total,
              "AbuseIPDB": F.coalesce(F.col("abuse_confidence_score"), F.lit(0)) / 100,
              "local": F.when(F.coalesce(F.col("is_malicious"), F.lit(False)), I.LOCAL_CONFIDENCE).otherwise(0.0)}
    for name, ratio in ratios.items():
        weight = weight.when(p == name, I.PROVIDER_WEIGHT[name])
        conf = conf.when(p == name, ratio)
    return results.groupBy("indicator").agg(
        F.max(F.coalesce(F.col("is_malicious"), F.lit(False))).alias("is_malicious"),
        F.least(F.coalesce(F.sum(conf.otherwise(None) * weight.otherwise(None)) / F.sum(weight.otherwise(None)),
                           F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.count(F.lit(1)).alias("n_providers"))


def typed_indicators(df: DataFrame, value: str) -> DataFrame:
    trimmed = F.trim(F.col(value))
    return df.withColumn("type", indicator_type(trimmed))


def expected_hits(expected: Column, detected: Column) -> Column:
    return F.size(F.array_intersect(expected, detected))


def technique_cards(spark) -> DataFrame:
    return spark.createDataFrame(
        A.TECHNIQUE_CARDS, "id string, name string, tactic string, description string, subtechniques array<string>, "
                           "mitigations array<string>")


def lookup_technique(cards: DataFrame, technique_id: str = "", keyword: str = "", limit: int = 5) -> DataFrame:
    """By id, else by sub-technique text, plus keyword over the whole card."""
    wanted = F.lit(False)
    if technique_id:
        tid = technique_id.strip().upper()
        exact = F.col("id") == tid
        sub = F.exists("subtechniques", lambda s: F.contains(s, F.lit(tid)))
        known = tid in {c[0] for c in A.TECHNIQUE_CARDS}
        wanted = wanted | (exact if known else sub)
    if keyword:
        text = F.lower(F.concat_ws(" ", "name", "description", "tactic", F.array_join("subtechniques", " ")))
        wanted = wanted | has(text, keyword.strip().lower())
    order = F.array_position(F.array(*[F.lit(c[0]) for c in A.TECHNIQUE_CARDS]), F.col("id"))
    return cards.where(wanted).orderBy(order).limit(limit)


def incident_type(per_incident: DataFrame) -> DataFrame:
    """(incident_id, technique_ids, hosts, p_<i>_<j> pattern flags) to (incident_type, type_confidence).

    Pattern flags come aggregated, see `incident_pattern_flags`; ten types are ten array entries, no join.
    """
    scores = []
    for i, (name, techs, patterns, weight, many) in enumerate(A.INCIDENT_TYPES):
        n = F.size(F.array_intersect("technique_ids", F.array(*[F.lit(t) for t in techs])))
        s = n * 0.3 * weight
        for j in range(len(patterns)):
            s = s + F.when(F.col(f"p_{i}_{j}"), 0.2 * weight).otherwise(0.0)
        if many:
            s = s + F.when(F.col("hosts") > 1, 0.3 * weight).otherwise(0.0)
        scores.append(F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name")))
    total = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x["s"])
    best = F.array_max("_scores")
    share = F.when(F.col("_total") > 0, F.col("_best.s") / F.col("_total")).otherwise(0.0)
    out = per_incident.withColumn("_scores", F.array(*scores)).withColumns({"_total": total, "_best": best})
    out = out.withColumn("type_confidence", share).withColumn(
        "incident_type", F.when(F.col("type_confidence") < 0.2, "unknown").otherwise(F.col("_best.name")))
    return out.drop("_scores", "_total", "_best", *[c for c in out.columns if c.startswith("p_")])


def incident_pattern_flags() -> list[Column]:
    """Aggregates: does the incident's text, all events in order, match the pattern.

    `a.*b` holds inside one event, or when the first event with a comes before the last one with b; both combine map-side.
    """
    text = F.concat(F.lit(" "), low("command_line"), F.lit(" "), low("process_name"))
    at = F.struct("event_ts", "event_key")

    def flag(pattern: str) -> Column:
        inside = F.max(_match(text, pattern))
        if ".*" not in pattern:
            return inside
        first, last = pattern.split(".*")
        across = F.min(F.when(has(text, first), at)) < F.max(F.when(has(text, last), at))
        return inside | F.coalesce(across, F.lit(False))

    return [flag(p).alias(f"p_{i}_{j}")
            for i, (_, _, patterns, _, _) in enumerate(A.INCIDENT_TYPES) for j, p in enumerate(patterns)]
