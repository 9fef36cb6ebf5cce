"""Queries on documents, pages, embeddings, conversations, orders and the intel tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import ioc
from tidewatch.functions.text import fold_ascii
from tidewatch.operators import knowledge, matching, models, scoring, vector_index
from tidewatch.operators.vector_index import VectorIndex
from tidewatch.plans.correlate import _IOCS
from tidewatch.plans.detect import b, events, lit, r, r6, se
from tidewatch.rules import intel as I
from tidewatch.schema import load, spread
from tidewatch.session import shared_dir

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def texts(spark, sf, table, *cols):
    return spread(load(spark, sf, table).select(*cols))


# ---------------------------------------------------------------- indicators in text
_DOC_KINDS = ("ip", "md5", "sha256", "url", "email", "file_path", "registry")


@query("document_indicators", "WITH m AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {lit(k)} AS type, trim(unnest(regexp_extract_all(text, {lit(I.IOC_PATTERNS_A[k])}))) AS value FROM documents" for k in _DOC_KINDS)
    + ") SELECT doc_id, type, value, count(*) AS n FROM m WHERE value <> '' AND NOT (type = 'ip' AND (" + " OR ".join(
        f"starts_with(value, {lit(p)})" for p in ("10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.3", "127.", "0.0.",
                                                  "169.254.")) + ")) GROUP BY ALL")
def document_indicators(spark, sf):
    found = texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.explode(ioc.text_indicators_a(F.col("text"))).alias("i"))
    out = found.where(F.col("i.type").isin(*_DOC_KINDS))
    return out.groupBy("doc_id", "i.type", "i.value").agg(F.count(F.lit(1)).alias("n"))


def _b_sql(table, key, text, kinds):
    parts = " UNION ALL ".join(f"SELECT {key}, {lit(k)} AS type, unnest(regexp_extract_all({text}, {lit('(?i)' + I.IOC_PATTERNS_B[k])})) AS value FROM {table}"
                               for k in kinds)
    private = ("type = 'ip' AND regexp_matches(value, '^(10|127)[.]|^192[.]168[.]|^172[.](1[6-9]|2[0-9]|3[01])[.]')")
    return f"m AS ({parts}), d AS (SELECT DISTINCT {key}, type, value FROM m WHERE NOT ({private}))"


_CONF = ("CASE type WHEN 'ip' THEN CASE WHEN " + " OR ".join(f"starts_with(value, {lit(p)})" for p in I.BAD_IP_PREFIXES) + " THEN 0.9 ELSE 0.5 END WHEN 'domain' "
         "THEN CASE WHEN " + " OR ".join(f"contains(lower(value), {lit(w)})" for w in I.BAD_DOMAIN_WORDS) + " THEN 0.8 ELSE 0.5 END + CASE WHEN length(value) < "
         "10 THEN 0.1 ELSE 0 END WHEN 'hash_md5' THEN 0.7 WHEN 'hash_sha1' THEN 0.7 WHEN 'hash_sha256' THEN 0.7 WHEN 'url' THEN CASE WHEN " + " OR ".join(
             f"contains(lower(value), {lit(w)})" for w in I.BAD_URL_WORDS) + " THEN 0.75 ELSE 0.5 END ELSE 0.5 END")
_B_KINDS = ("ip", "domain", "hash_md5", "hash_sha1", "hash_sha256", "url", "registry")


@query("page_indicators", f"WITH {_b_sql('pages', 'page_id', 'url', _B_KINDS)} SELECT page_id, type, value, {r6(_CONF)} AS confidence FROM d")
def page_indicators(spark, sf):
    found = texts(spark, sf, "pages", "page_id", "url").select("page_id", F.explode(ioc.text_indicators_b(F.col("url"))).alias("i")).select(
        "page_id", "i.*").where(F.col("type").isin(*_B_KINDS))
    return found.select("page_id", "type", "value", r(ioc.confidence_b(F.col("type"), F.col("value"))).alias("confidence"))


@query("page_text_indicators", f"WITH {_b_sql('pages', 'page_id', 'html', ('ip', 'hash_md5', 'email', 'url'))} SELECT type, count(*) AS n, count(DISTINCT value) AS values FROM d "
       "GROUP BY 1")
def page_text_indicators(spark, sf):
    found = texts(spark, sf, "pages", "page_id", "html").select("page_id", F.explode(ioc.text_indicators_b(F.col("html"))).alias("i")).select(
        "page_id", "i.*").where(F.col("type").isin("ip", "hash_md5", "email", "url"))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("values"))


@query("page_domains")
def page_domains(spark, sf):
    """Domains of whole pages, distinct per page: the pattern backtracks on long tokens, so no second engine runs it."""
    found = texts(spark, sf, "pages", "page_id", "html").select(F.explode(ioc.text_indicators_b(F.col("html"))).alias("i")).select("i.*")
    return found.where("type = 'domain'").groupBy("value").agg(F.count(F.lit(1)).alias("pages"))


@query("folded_text", "SELECT doc_id, md5(translate(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g'), '\"''`', '')) AS digest FROM documents")
def folded_text(spark, sf):
    return texts(spark, sf, "documents", "doc_id", "text").select("doc_id", F.md5(fold_ascii("text")).alias("digest"))


# ---------------------------------------------------------------- intel
_TYPED = ("CASE WHEN regexp_matches(v, '^[0-9]{1,3}([.][0-9]{1,3}){3}$') THEN 'ip' WHEN regexp_matches(v, '^[a-fA-F0-9]{32}$') THEN 'hash_md5' WHEN "
          "regexp_matches(v, '^[a-fA-F0-9]{40}$') THEN 'hash_sha1' WHEN regexp_matches(v, '^[a-fA-F0-9]{64}$') THEN 'hash_sha256' WHEN starts_with(v, "
          "'http://') OR starts_with(v, 'https://') THEN 'url' WHEN contains(v, '.') AND NOT ends_with(v, '.exe') THEN 'domain' ELSE 'process' END")


@query("indicator_types", f"WITH {se()}, {_IOCS}, d AS (SELECT DISTINCT value AS v FROM ei) SELECT v AS value, {_TYPED} AS type FROM d")
def indicator_types(spark, sf):
    rows = events(spark, sf).select(F.explode(ioc.event_indicators_a(_fields())).alias("i")).select(F.col("i.value").alias("value")).distinct()
    return matching.typed_indicators(rows, "value")


def _fields():
    from tidewatch.operators.incidents import IOC_FIELDS

    return IOC_FIELDS


_INTEL = "CASE " + " ".join(
    f"WHEN starts_with(type, {lit(t)}) AND {'value' if t == 'ip' else 'lower(value)'} = {lit(v)} THEN {lit(d)}" for t, v, d in I.LOCAL_INTEL) + " " + " ".join(
    f"WHEN type = 'process' AND contains(lower(value), {lit(w)}) THEN {lit(d)}" for w, d in I.LOCAL_PROCESSES) + f" ELSE {lit(I.NOT_LISTED)} END"


@query("local_intel", f"WITH {se()}, {_IOCS}, d AS (SELECT DISTINCT type, value FROM ei WHERE type IN ('ip', 'domain', 'process')) SELECT type, value, {_INTEL} AS "
       f"details, {_INTEL} <> {lit(I.NOT_LISTED)} AS is_malicious FROM d")
def local_intel(spark, sf):
    rows = events(spark, sf).select(F.explode(ioc.event_indicators_a(_fields())).alias("i")).select("i.*").where(
        F.col("type").isin("ip", "domain", "process")).distinct()
    return matching.local_intel(rows).select("type", "value", "details", "is_malicious")


_PROV = ("prov AS (SELECT source_ip AS indicator, 'VirusTotal' AS provider, CAST(count(*) AS INT) AS votes, 70 AS engines, CAST(NULL AS INT) AS abuse, count(*) >= 3 AS "
         "bad FROM se GROUP BY 1 UNION ALL SELECT source_ip, 'AbuseIPDB', NULL, NULL, CAST(count(*) * 5 AS INT), count(*) * 5 >= 25 FROM se WHERE source_ip LIKE "
         "'185.%' GROUP BY 1 UNION ALL SELECT DISTINCT source_ip, 'local', CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), source_ip IN "
         "('185.220.101.1', '185.220.101.2', '185.220.101.3') FROM se)")


@query("provider_verdicts", f"WITH {se('source_ip')}, {_PROV}, w AS (SELECT indicator, bad, CASE provider WHEN 'VirusTotal' THEN 0.6 WHEN 'AbuseIPDB' THEN 0.5 ELSE 0.3 END AS w, "
       "CASE provider WHEN 'VirusTotal' THEN votes / 70.0 WHEN 'AbuseIPDB' THEN abuse / 100.0 ELSE CASE WHEN bad THEN 0.6 ELSE 0 END END AS c FROM prov) SELECT indicator, "
       f"bool_or(bad) AS is_malicious, {r6('least(sum(w * c) / sum(w), 1.0)')} AS confidence, count(*) AS n_providers FROM w GROUP BY 1")
def provider_verdicts(spark, sf):
    ev = events(spark, sf, "source_ip").withColumnRenamed("source_ip", "indicator")
    n = F.count(F.lit(1)).cast("int")
    none = F.lit(None).cast("int")
    vt = ev.groupBy("indicator").agg(n.alias("malicious_votes")).select(
        "indicator", F.lit("VirusTotal").alias("provider"), "malicious_votes", F.lit(70).alias("total_engines"), none.alias(
            "abuse_confidence_score"), (F.col("malicious_votes") >= 3).alias("is_malicious"))
    ab = ev.where(F.startswith("indicator", F.lit("185."))).groupBy("indicator").agg((n * 5).alias("abuse_confidence_score")).select(
        "indicator", F.lit("AbuseIPDB").alias("provider"), none.alias("malicious_votes"), none.alias("total_engines"), "abuse_confidence_score",
        (F.col("abuse_confidence_score") >= 25).alias("is_malicious"))
    lo = matching.local_intel(ev.distinct().select(F.col("indicator").alias("value"), F.lit("ip").alias("type"))).select(
        F.col("value").alias("indicator"), F.lit("local").alias("provider"), none.alias("malicious_votes"), none.alias("total_engines"),
        none.alias("abuse_confidence_score"), "is_malicious")
    return matching.provider_verdict(vt.unionByName(ab).unionByName(lo)).select("indicator", "is_malicious", r("confidence").alias(
        "confidence"), "n_providers")


# ---------------------------------------------------------------- chunks and vectors
@query("document_chunks")
def document_chunks(spark, sf):
    """All chunks of all documents; the cut is sequential, so it has no SQL form. Tests compare it with a plain loop."""
    return knowledge.chunk_documents(texts(spark, sf, "documents", "doc_id", "text", "source")).select(
        "doc_id", "chunk_index", "char_start", "char_end", F.md5("chunk").alias("digest"))


@query("chunk_coverage", "SELECT doc_id, CAST(length(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS BIGINT) AS n_chars FROM documents WHERE length(trim(text, ' ' || "
       "chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) > 0")
def chunk_coverage(spark, sf):
    """Chunks reach from the first to the last character of each document."""
    c = knowledge.chunk_documents(texts(spark, sf, "documents", "doc_id", "text", "source"))
    end = F.least(F.col("char_end"), F.col("char_start") + knowledge.CHUNK_SIZE)
    ends = c.groupBy("doc_id").agg(F.max(F.struct("char_start", end.alias("e"), F.length("chunk").alias("n"))).alias("m"))
    docs = load(spark, sf, "documents").select("doc_id", F.length(F.regexp_replace("text", r"^[\s]+|[\s]+$", "")).alias("n"))
    return ends.join(docs, "doc_id").where(F.col("m.e") >= F.col("n")).select("doc_id", b("n").alias("n_chars"))


def query_vectors(spark, sf):
    """One query per label class: the vector with the lowest id."""
    e = load(spark, sf, "embeddings")
    return e.groupBy(F.col("label").alias("query_id")).agg(F.min_by(F.col("embedding").cast("array<double>"), "vec_id").alias(
        "query_vector"))


_QV = ("qv AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY 1), s AS (SELECT query_id, vec_id, "
       "list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM qv, embeddings)")


@query("vector_top_k", f"WITH {_QV} SELECT query_id, vec_id, {r6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5")
def vector_top_k(spark, sf):
    out = knowledge.vector_top_k(load(spark, sf, "embeddings"), query_vectors(spark, sf), k=5)
    return out.select("query_id", "vec_id", r("score").alias("score"))


@query("findings_recall", f"WITH {_QV}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s) SELECT query_id, vec_id, "
       f"{r6('score')} AS score FROM t WHERE rk <= 3 AND score >= 0.25")
def findings_recall(spark, sf):
    out = knowledge.recall_findings(load(spark, sf, "embeddings"), query_vectors(spark, sf))
    return out.select("query_id", "vec_id", r("score").alias("score"))


@query("knowledge_context", f"WITH {_QV}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s), h AS (SELECT query_id, rk, length(text) AS n, "
       "source FROM t JOIN documents ON doc_id = vec_id WHERE rk <= 5 AND score >= 0.3) SELECT query_id, max(CASE WHEN rk = 1 THEN source END) AS first_source FROM h GROUP BY 1")
def knowledge_context(spark, sf):
    """Search, threshold, text of the hits, packing; read back: the source of the first entry."""
    hits = knowledge.vector_top_k(load(spark, sf, "embeddings"), query_vectors(spark, sf), k=5, floor=0.3)
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source", "text", F.lit("").alias("title"))
    packed = knowledge.pack_context(hits.join(docs, "vec_id"))
    first = F.regexp_extract("context", r"^\[1\] \(score=[^,]*, source=([^)]*)\)", 1)
    return packed.select("query_id", F.when(first != "", first).alias("first_source"))


_INDEXED = ("q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, "
            "list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings)")


@query("indexed_top_k", f"WITH {_INDEXED} SELECT query_id, vec_id, {r6('score')} AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "
       "vec_id) <= 5")
def indexed_top_k(spark, sf):
    """Exact search through the index, built on four fifths of the rows and appended the rest: every fiftieth row against all."""
    emb = load(spark, sf, "embeddings")
    index = VectorIndex(spark, shared_dir(spark, "index")).build(emb.where("vec_id % 5 <> 0")).append(emb.where("vec_id % 5 = 0"))
    asked = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found, _ = index.search(asked, 5)
    return found.select("query_id", "vec_id", r("score").alias("score"))


_MINOR = "m AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), e AS (SELECT * FROM embeddings JOIN m USING (label) WHERE n < (SELECT max(n) FROM m))"


@query("minority_neighbours", f"WITH {_MINOR}, p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS gap "
       "FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT vec_id, neighbour, round(gap, 6) AS gap FROM p QUALIFY row_number() OVER (PARTITION BY "
       "vec_id ORDER BY gap, neighbour) <= 5")
def minority_neighbours(spark, sf):
    """The exact five nearest rows of its class for every row of a class smaller than the largest."""
    emb = load(spark, sf, "embeddings")
    sizes = {x.label: x.n for x in emb.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = shared_dir(spark, "classes")

    def one(name):
        return vector_index.nearest(spark, emb.where(F.col("label") == name).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")),
                                    "vec_id", "embedding", f"{base}/{name}", 5)

    found = models.side_by_side(spark, one, sorted(k for k, n in sizes.items() if n < max(sizes.values())))
    if not found:
        return emb.select("vec_id", F.col("vec_id").alias("neighbour"), F.lit(0.0).alias("gap")).limit(0)
    return reduce(DataFrame.unionByName, found).select("vec_id", "neighbour", F.round("gap", 6).alias("gap"))


@query("balanced_classes", "WITH m AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, CAST((SELECT max(n) FROM m) - n AS BIGINT) AS n, 64::INT AS width "
       "FROM m WHERE n < (SELECT max(n) FROM m)")
def balanced_classes(spark, sf):
    """Interpolated rows per class: as many as it lacks to the largest."""
    made = vector_index.interpolate(load(spark, sf, "embeddings"), "vec_id", "embedding", "label", shared_dir(spark, "classes"))
    return made.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"))


# ---------------------------------------------------------------- conversations and other tables
@query("recent_messages", "SELECT conv_id, turn, role, md5(substring(text, 1, 500)) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY "
       "turn DESC) <= 20")
def recent_messages(spark, sf):
    return knowledge.recent_messages(load(spark, sf, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


_ANS = ("CASE CAST(turn % 6 AS INT) WHEN 0 THEN concat('clearly malicious: ', substring(text, 1, 10)) WHEN 1 THEN concat('This is not malicious. ', substring(text, 1, 10)) "
        "WHEN 2 THEN 'a false positive' WHEN 3 THEN 'looks suspicious' WHEN 4 THEN 'benign traffic' ELSE substring(text, 1, 3) END")


@query("answer_verdicts", f"WITH a AS (SELECT conv_id, turn, upper({_ANS}) AS t FROM conversations), v AS (SELECT *, CASE WHEN contains(t, 'MALICIOUS') THEN CASE WHEN contains(t, "
       "'NOT MALICIOUS') THEN 2 ELSE 1 END WHEN contains(t, 'FALSE POSITIVE') THEN 3 WHEN contains(t, 'SUSPICIOUS') THEN 4 WHEN contains(t, 'BENIGN') THEN 2 ELSE 5 END AS c FROM "
       "a) SELECT conv_id, turn, CASE c WHEN 1 THEN 'MALICIOUS' WHEN 2 THEN 'FALSE_POSITIVE' WHEN 3 THEN 'FALSE_POSITIVE' ELSE 'SUSPICIOUS' END AS verdict, CAST(CASE c WHEN 1 THEN 0.9 "
       "WHEN 2 THEN 0.7 WHEN 3 THEN 0.8 WHEN 4 THEN 0.6 ELSE 0.5 END AS DOUBLE) AS confidence FROM v")
def answer_verdicts(spark, sf):
    t = load(spark, sf, "conversations").select("conv_id", "turn", scoring.verdict(F.expr(_ANS)).alias("v"))
    return t.select("conv_id", "turn", "v.verdict", "v.confidence")


@query("analysis_defaults", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN CAST(turn AS INT) ELSE 0 END AS threat_score, 'low' AS threat_level, 'No threat detected' AS summary "
       "FROM conversations")
def analysis_defaults(spark, sf):
    t = load(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string")).alias("threat_score"))
    return scoring.analysis_defaults(t).select("conv_id", "turn", "threat_score", "threat_level", "summary")


@query("most_recent", "SELECT event_id AS event_key, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def most_recent(spark, sf):
    t = load(spark, sf, "events").select(F.col("event_id").alias("event_key"), "user_id", "ts")
    return knowledge.most_recent(t, ["ts", "event_key"]).select("event_key", "user_id")


@query("tactic_severity", "SELECT o_orderpriority AS tactic, CASE WHEN contains(o_orderpriority, 'Execution') THEN 2 WHEN o_orderpriority LIKE '%Other%' THEN 1 ELSE 0 END AS severity, "
       "count(*) AS n FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 'Execution' WHEN 'O' THEN 'Other' ELSE 'none' END AS o_orderpriority FROM orders) GROUP BY ALL")
def tactic_severity(spark, sf):
    from tidewatch.operators.features import tactic_severity as sev

    t = load(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "Execution").when(F.col("o_orderstatus") == "O", "Other").otherwise(
        "none").alias("tactic"))
    return t.groupBy("tactic", sev(F.col("tactic")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("shared_texts", "SELECT count(*) AS shared FROM (SELECT md5(text) FROM documents INTERSECT SELECT md5(text) FROM benchmark)")
def shared_texts(spark, sf):
    d, k = (load(spark, sf, t).select(F.md5("text").alias("k")) for t in ("documents", "benchmark"))
    return d.intersect(k).agg(F.count(F.lit(1)).alias("shared"))


@query("unlabelled_documents", "SELECT source, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def unlabelled_documents(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source")
    return d.join(load(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


