"""Queries over the driver's tables, one for each operator of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import load_aliases, load_descriptions, load_mapping
from ..functions import scoring
from ..functions.identifiers import identifiers, values_of
from ..functions.text import normalize, word_list
from ..functions.times import format_time, parse_time
from ..functions.variants import has_value, payload, plain, read_path
from ..operators.documents import text_documents
from ..operators.exact import field_events, field_values
from ..operators.extract import extract, long_form
from ..operators.inventory import summarise
from ..operators.quality import density
from ..operators.resolve import phrase_table, resolve
from ..operators.router import text_route
from ..operators.search import analyse, bm25, bm25_batch, exact_ids, fuzzy, fuzzy_pairs, near_hosts, scored_terms, vocabulary
from ..session import configure
from .incidents import DOCUMENT_SEARCH, DOCUMENT_TYPO, _scratch, numbered
from .incidents import QUERIES as INCIDENT_QUERIES

QUERY = DOCUMENT_SEARCH
IP_QUERY = "192.168.0.1"
TYPO = DOCUMENT_TYPO
HOST_QUERY = "thher.example.org"
QUESTIONS = ("What is the source ip?", "source ip", "show the registry key value", "command line of the process", "file", "hostname of the computer", "user name", "zebra")
EVENT_FIELDS = {"type": ["event.event_type"], "user": ["event.user_id"], "k": ["utf8_payload.missing", "utf8_payload.k"], "none": ["utf8_payload.absent[].x"]}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, sf_dir) -> DataFrame:
    return text_documents(_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "source")


_stored: dict[tuple[str, str], str] = {}


def stored_documents(spark, sf_dir) -> DataFrame:
    """The documents, analysed and written once for each application: a search passes over them several times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = _scratch(spark, "text-documents")
        documents(spark, sf_dir).write.parquet(path)
        _stored[key] = path
    return configure(spark).read.parquet(_stored[key])


def page_hosts(spark, sf_dir) -> DataFrame:
    return text_documents(_table(spark, sf_dir, "pages"), "page_id", F.col("url"))


def raw_events(spark, sf_dir) -> DataFrame:
    """The events table as incidents: a user is an incident, props is the payload."""
    t = numbered(_table(spark, sf_dir, "events"))
    return t.select("offense_id", "event_id", "ts", "event_type", F.to_variant_object(F.struct("event_type", "user_id", F.col("props").alias("utf8_payload"))).alias("event"), "event_index")


def event_records(spark, sf_dir) -> DataFrame:
    return extract(raw_events(spark, sf_dir), EVENT_FIELDS)


def payload_path_extract(spark, sf_dir):
    e = raw_events(spark, sf_dir)
    held = read_path(F.col("event"), payload(F.col("event")), "utf8_payload.k")
    return e.select("event_id", plain(F.get(held["items"], F.lit(0))).cast("long").alias("k"))


def payload_fallback_path(spark, sf_dir):
    return event_records(spark, sf_dir).select("offense_id", "event_index", plain(F.get(F.col("fields")["k"]["items"], F.lit(0))).alias("k"), F.size(F.col("fields")["none"]["items"]).cast("long").alias("n_none"))


def array_collect_dedup(spark, sf_dir):
    """Distinct values in order of first appearance, without gathering the repeats."""
    first = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("at", "event_type"))).alias("v")).select("user_id", F.array_join("v.event_type", ",").alias("event_types"))


def records_long(spark, sf_dir):
    return long_form(event_records(spark, sf_dir)).select("offense_id", "event_index", "field", F.col("pos").cast("long").alias("pos"), "value")


def event_index(spark, sf_dir):
    return raw_events(spark, sf_dir).select("offense_id", "event_id", "event_index")


def exact_field_values(spark, sf_dir):
    return field_values(event_records(spark, sf_dir), ["type"]).select("value")


def exact_field_count(spark, sf_dir):
    r = event_records(spark, sf_dir)
    return r.groupBy("offense_id").agg(F.count_if(has_value(F.col("fields")["type"])).alias("event_count"), F.count_if(has_value(F.col("fields")["none"])).alias("none_count"))


def exact_tied_fields(spark, sf_dir):
    return field_values(event_records(spark, sf_dir), ["type", "k"]).select("value")


def matching_event_rows(spark, sf_dir):
    r = event_records(spark, sf_dir)
    found = field_events(r.where(F.col("fields")["k"]["items"] == F.array(F.lit("7"))), ["k"])
    return r.join(found, ["offense_id", "event_index"], "left_semi").select("offense_id", "event_index", plain(F.get(F.col("fields")["type"]["items"], F.lit(0))).alias("event_type"))


def resolve_field(spark, sf_dir):
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")
    return resolve(asked, phrase_table(spark)).select(F.col("question_id").cast("long").alias("question_id"), "rank", "field", "score", "matched_alias", "reason")


def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("norm"))


def word_tokens_tf(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").select("doc_id", F.explode(word_list(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequency(spark, sf_dir):
    return vocabulary(documents(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count("*").alias("n"), F.bround(F.avg(F.size("tokens")), 6).alias("avgdl"))


def idf(spark, sf_dir):
    d = stored_documents(spark, sf_dir)
    return vocabulary(d).select("term", F.bround(scoring.idf(float(d.count()), F.col("df").cast("double")), 4).alias("idf"))


def _hits(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    terms = F.array_join(F.transform("matched_terms", lambda m: F.concat_ws(">", m["query_term"], m["matched_term"])), ",")
    return rows.select(F.col("event_id").alias(key), "score", terms.alias("matched_terms"), F.array_join("matched_identifiers", ",").alias("matched_identifiers"))


def bm25_topk(spark, sf_dir):
    return _hits(bm25(stored_documents(spark, sf_dir), QUERY))


def bm25_scoped(spark, sf_dir):
    return _hits(bm25(stored_documents(spark, sf_dir).where("offense_id = 'src3'"), QUERY, limit=5))


def bm25_many(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark")
    asked = b.select(F.col("item_id").alias("query_id"), F.concat(word_list(F.col("text")), values_of(identifiers(F.col("text")))).alias("tokens"))
    return bm25_batch(stored_documents(spark, sf_dir), asked).select("query_id", F.col("event_id").alias("doc_id"), "score", "rank")


def _ids(category: str, table: str = "documents", key: str = "doc_id", text: str = "text"):
    def run(spark, sf_dir):
        t = _table(spark, sf_dir, table)
        return t.select(key, F.explode(identifiers(F.col(text))[category]).alias("value"))

    return run


def query_type(spark, sf_dir):
    t = _table(spark, sf_dir, "benchmark").select("item_id", F.size(values_of(identifiers(F.col("text")))).alias("n"))
    return t.select("item_id", F.when(F.col("n") > 0, "identifier_like").otherwise("free_text").alias("query_type"))


def identifier_gate(spark, sf_dir):
    d = stored_documents(spark, sf_dir)
    known = d.select(F.explode("ids.ip").alias("v")).agg(F.min("v")).first()[0] or IP_QUERY
    return d.select(F.col("event_id").alias("doc_id"), F.array_join(F.array_sort(exact_ids(analyse(known))), ",").alias("matched")).where("matched <> ''")


def fuzzy_terms(spark, sf_dir):
    t = scored_terms(documents(spark, sf_dir), analyse(TYPO).tokens)
    return t.select("query_term", "term", F.bround("match", 4).alias("score"), "kind", "df")


def best_fuzzy_match(spark, sf_dir):
    p = fuzzy_pairs(stored_documents(spark, sf_dir), analyse(TYPO))
    return p.select(F.col("load_ord").alias("doc_id"), "query_term", "term", "match", F.bround("weight", 4).alias("weight"))


def fuzzy_topk(spark, sf_dir):
    return _hits(fuzzy(stored_documents(spark, sf_dir), TYPO))


def routed_search(spark, sf_dir):
    got = text_route(stored_documents(spark, sf_dir), TYPO)
    rows = [(got.method, r["event_id"], r["score"], k) for k, r in enumerate(got.result)]
    return spark.createDataFrame(rows, "method string, doc_id long, score double, rank long")


def host_fuzzy(spark, sf_dir):
    d = page_hosts(spark, sf_dir)
    return d.select(F.col("event_id").alias("page_id"), F.explode(near_hosts(analyse(HOST_QUERY))).alias("host"))


def host_containment(spark, sf_dir):
    d = page_hosts(spark, sf_dir)
    q = analyse("example.net")
    return d.select(F.col("event_id").alias("page_id"), F.explode(F.array_sort(exact_ids(q))).alias("host"))


def inventory(spark, sf_dir):
    t = _table(spark, sf_dir, "events")
    doc = F.to_variant_object(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("starttime"), F.col("event_type").alias("logsourceid"), F.col("props").alias("utf8_payload")))
    rows = t.select(F.col("user_id").cast("string").alias("offense_id"), F.lit(0).alias("event_index"), doc.alias("event"))
    r = extract(rows, {"qradar.starttime": ["event.starttime"], "cisco.date": ["utf8_payload.date"], "qradar.logsourceid": ["event.logsourceid"]})
    return summarise(r).select("offense_id", "number_of_events", format_time(F.col("first")).alias("first_event_time"), format_time(F.col("last")).alias("last_event_time"), "logsourceid")


def epoch_to_timestamp(spark, sf_dir):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    t = _table(spark, sf_dir, "events").select("event_id", micros.alias("u"))
    shapes = {"from_s": F.floor(F.col("u") / 1000000).cast("long"), "from_ms": F.floor(F.col("u") / 1000).cast("long"), "from_us": F.col("u"), "from_ns": F.col("u") * 1000}
    return t.select("event_id", *[format_time(parse_time(c.cast("string"))).alias(n) for n, c in shapes.items()])


def field_density(spark, sf_dir):
    r = density(event_records(spark, sf_dir))
    return r.groupBy("offense_id").agg(F.min("non_empty").cast("long").alias("low"), F.bround(F.avg("non_empty"), 2).alias("mean"), F.max("non_empty").cast("long").alias("high"))


def sparse_rows(spark, sf_dir):
    return density(event_records(spark, sf_dir)).where("non_empty < 8").groupBy("offense_id").agg(F.count("*").alias("sparse"))


def duplicate_keys(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem")
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def missing_ids(spark, sf_dir):
    r = event_records(spark, sf_dir)
    return r.groupBy("offense_id").agg(F.count_if(F.col("event_id").isNull()).alias("missing"))


def coverage_check(spark, sf_dir):
    m, a, d = load_mapping(), load_aliases(), load_descriptions(None)
    names = [spark.createDataFrame([(x,) for x in xs], "name string") for xs in (m, a, d)]
    gaps = [names[0].join(names[1], "name", "left_anti"), names[1].join(names[0], "name", "left_anti"), names[0].join(names[2], "name", "left_anti")]
    out = gaps[0].unionByName(gaps[1]).unionByName(gaps[2]).agg(F.count("*").alias("gaps"))
    return out.select("gaps", F.lit(len(m)).cast("long").alias("fields"))


def identifier_sets(spark, sf_dir):
    """Intersection, union and difference of the words of English and of all other documents."""
    t = _table(spark, sf_dir, "documents").select(F.coalesce(F.col("lang") == "en", F.lit(False)).alias("en"), F.explode(word_list(F.col("text"))).alias("term"))
    a, b = (t.where(test).select("term").distinct() for test in ("en", "not en"))
    parts = {"both": a.intersect(b), "either": a.union(b).distinct(), "first_only": a.exceptAll(b)}
    out = None
    for name, p in parts.items():
        one = p.agg(F.lit(name).alias("what"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def scope_scan(spark, sf_dir):
    t = _table(spark, sf_dir, "documents").where("source = 'src5'")
    return t.select("doc_id", "lang")


def combined_scopes(spark, sf_dir):
    t = _table(spark, sf_dir, "documents")
    one, two = (t.where(test).select("source", "doc_id") for test in ("coalesce(lang = 'en', false)", "not coalesce(lang = 'en', false)"))
    both = one.unionByName(two)
    return both.withColumn("load_ord", (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).cast("long"))


def intake_stream(spark, sf_dir):
    """The events table as raw files, one for each user, taken in by a stream."""
    import tempfile
    import uuid

    from ..sources.records import BY_TASKS, scan
    from ..streaming.intake import stream_intake

    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="eventlantern-")
    top = f"{at.rstrip('/')}/intake-{uuid.uuid4().hex}"
    events = F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("category"), F.col("props").alias("utf8_payload"))))
    raw = _table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("offense_id")).agg(F.to_json(F.struct(events.alias("events"))).alias("value"))
    raw.repartition("offense_id").write.options(**BY_TASKS).partitionBy("offense_id").text(f"{top}/raw")
    stream_intake(spark, f"{top}/raw", f"{top}/records", f"{top}/checkpoint", {"category": ["event.category"], "k": ["utf8_payload.k"]}).awaitTermination()
    told = F.get(F.col("fields")["category"]["items"], F.lit(0))
    return scan(spark, f"{top}/records").select("offense_id", "event_index", plain(told).alias("event_type"))


QUERIES = {
    **INCIDENT_QUERIES,
    "payload_path_extract": payload_path_extract, "payload_fallback_path": payload_fallback_path, "array_collect_dedup": array_collect_dedup, "records_long": records_long, "event_index": event_index,
    "exact_field_values": exact_field_values, "exact_field_count": exact_field_count, "exact_tied_fields": exact_tied_fields, "matching_event_rows": matching_event_rows, "resolve_field": resolve_field,
    "normalize_text": normalize_text, "word_tokens_tf": word_tokens_tf, "document_frequency": document_frequency, "corpus_stats": corpus_stats, "idf": idf,
    "bm25_topk": bm25_topk, "bm25_scoped": bm25_scoped, "bm25_batch": bm25_many,
    "identifiers_ip": _ids("ip"), "identifiers_dotted": _ids("dotted_numeric"), "identifiers_hash": _ids("hash"), "identifiers_uuid": _ids("uuid"), "identifiers_filename": _ids("file_name"),
    "identifiers_registry": _ids("registry_path", "pages", "page_id", "html"), "identifiers_hostname": _ids("hostname"), "identifiers_url_host": _ids("hostname", "pages", "page_id", "url"),
    "query_type": query_type, "identifier_gate": identifier_gate, "fuzzy_terms": fuzzy_terms, "best_fuzzy_match": best_fuzzy_match, "fuzzy_topk": fuzzy_topk, "routed_search": routed_search,
    "host_fuzzy": host_fuzzy, "host_containment": host_containment, "inventory": inventory, "epoch_to_timestamp": epoch_to_timestamp, "field_density": field_density, "sparse_rows": sparse_rows,
    "duplicate_keys": duplicate_keys, "missing_ids": missing_ids, "coverage_check": coverage_check, "identifier_sets": identifier_sets, "scope_scan": scope_scan, "combined_scopes": combined_scopes, "intake_stream": intake_stream,
}
