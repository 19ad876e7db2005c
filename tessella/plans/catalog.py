"""Every registered query of the reference's operators on the driver's tables, and the SQL that an independent engine runs for it.

Surrogates: a study is a user and a day of `events`, its labels are event types, a reader is the parity of the event id,
prob is value / 100 up to 1. Report sentences are `lineitem` rows citing `l_partkey`; known evidence are small parts.
Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import replies, rules, text, vocab
from ..operators import agreement, calibrate, evidence, findings, gates, retrieval, search
from ..sources import archives, corpus, store
from ..streaming import channels, feed
from . import dashboard, ledger, models, session, studies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = ("view", "click", "purchase")
CRITICAL = ("error", "purchase")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, n: int = 6) -> Column:
    return F.round(c, n)


def _z(c) -> Column:
    """Rounded, without a negative zero."""
    return F.when(_r(c) == 0, F.lit(0.0)).otherwise(_r(c))


def readings(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("study_id"), F.col("event_type").alias("label"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("reader"),
        F.least(F.col("value") / 100e0, F.lit(1e0)).alias("prob"), F.col("event_id").cast("string").alias("image_ref"), F.col("event_id").alias("ord"),
    )


_READ = """r AS (SELECT user_id || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS study_id, event_type AS label, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS reader,
  least(value / 100e0, 1e0) AS prob, CAST(event_id AS VARCHAR) AS image_ref, event_id AS ord FROM events)"""
_MATCH = f"""{_READ}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id, label, reader ORDER BY ord DESC) AS k FROM r) WHERE k = 1),
m AS (SELECT coalesce(x.study_id, y.study_id) AS study_id, coalesce(x.label, y.label) AS label, x.prob AS a_prob, y.prob AS b_prob
  FROM (SELECT * FROM l WHERE reader = 'a') x FULL JOIN (SELECT * FROM l WHERE reader = 'b') y ON x.study_id = y.study_id AND x.label = y.label),
g AS (SELECT *, CASE WHEN a_prob IS NULL OR b_prob IS NULL THEN CASE WHEN coalesce(a_prob, b_prob) >= 0.5 THEN 'unique' ELSE 'agree' END
  WHEN (a_prob >= 0.5) <> (b_prob >= 0.5) THEN 'presence' WHEN a_prob >= 0.5 AND abs(a_prob - b_prob) >= 0.3e0 THEN 'magnitude' ELSE 'agree' END AS kind,
  label IN ('view', 'click', 'purchase') AS in_vocabulary FROM m)"""
_KAPPA = """CASE WHEN {n} = 0 OR ({a} * 1e0 / {n}) * ({b} * 1e0 / {n}) + (1 - {a} * 1e0 / {n}) * (1 - {b} * 1e0 / {n}) >= 1 - 1e-9 THEN 1e0
  ELSE ({s} * 1e0 / {n} - (({a} * 1e0 / {n}) * ({b} * 1e0 / {n}) + (1 - {a} * 1e0 / {n}) * (1 - {b} * 1e0 / {n}))) / (1 - (({a} * 1e0 / {n}) * ({b} * 1e0 / {n}) + (1 - {a} * 1e0 / {n}) * (1 - {b} * 1e0 / {n}))) END"""


def _counts(where: str, x: str) -> str:
    f = f"FILTER (WHERE {where}"
    return f"count(*) {f}) AS n{x}, count(*) {f} AND coalesce(a_prob >= 0.5, false)) AS a{x}, count(*) {f} AND coalesce(b_prob >= 0.5, false)) AS b{x}, count(*) {f} AND coalesce(a_prob >= 0.5, false) = coalesce(b_prob >= 0.5, false)) AS s{x}"


def _kappa(x: str) -> str:
    return _KAPPA.format(n=f"n{x}", a=f"a{x}", b=f"b{x}", s=f"s{x}")


@query(f"WITH {_MATCH}, k AS (SELECT study_id, {_counts('true', 'w')} FROM m GROUP BY 1) SELECT study_id, nw AS n_labels, round({_kappa('w')}, 6) + 0e0 AS kappa FROM k")
def reader_agreement_kappa(spark, d):
    return agreement.kappa(agreement.matched(readings(spark, d))).select("study_id", "n_labels", _z("kappa").alias("kappa"))


def _merged(spark, d):
    return agreement.merge(readings(spark, d), vocabulary=WORDS)


@query(f"WITH {_MATCH} SELECT kind, in_vocabulary, count(*) AS n, count(DISTINCT study_id) AS studies FROM g GROUP BY ALL")
def reader_disagreement_kinds(spark, d):
    return _merged(spark, d).groupBy("kind", "in_vocabulary").agg(F.count("*").alias("n"), F.count_distinct("study_id").alias("studies"))


@query(f"""WITH {_MATCH}, f AS (SELECT g.*, b_prob IS NULL OR a_prob >= b_prob AS a_wins FROM g WHERE kind = 'agree')
  SELECT f.study_id, f.label, CASE WHEN a_wins THEN a_prob ELSE b_prob END AS prob, CASE WHEN a_wins THEN 'a' ELSE 'b' END AS source, l.image_ref
  FROM f JOIN l ON f.study_id = l.study_id AND f.label = l.label AND l.reader = CASE WHEN a_wins THEN 'a' ELSE 'b' END""")
def merged_findings(spark, d):
    return _merged(spark, d).where("kind = 'agree'").select("study_id", "label", "prob", "source", "image_ref")


@query(f"""WITH {_MATCH}, k AS (SELECT study_id, {_counts("label <> 'signup'", 'w')} FROM m GROUP BY 1), b AS (SELECT study_id, count(*) FILTER (WHERE label <> 'signup') = 0 AS strange FROM r WHERE reader = 'b' GROUP BY 1)
  SELECT k.study_id, CASE WHEN coalesce(strange, false) THEN 0e0 ELSE round({_kappa('w')}, 6) + 0e0 END AS kappa FROM k LEFT JOIN b ON k.study_id = b.study_id""")
def kappa_second_reader_unmapped(spark, d):
    rows = readings(spark, d).withColumn("mapped", F.col("label") != "signup")
    k = agreement.kappa(agreement.matched(rows), universe=F.col("label") != "signup")
    return agreement.measurable_kappa(k, rows.where("reader = 'b'")).select("study_id", _z("kappa").alias("kappa"))


@query(f"""WITH {_MATCH} SELECT study_id, list_sort(coalesce(list(label) FILTER (WHERE a_prob IS NOT NULL AND b_prob IS NOT NULL), [])) AS labels FROM m GROUP BY 1""")
def labels_both_named(spark, d):
    return agreement.both_named(agreement.matched(readings(spark, d)))


@query(f"WITH {_MATCH}, k AS (SELECT study_id, {_counts('in_vocabulary', 'n')}, {_counts('true', 'w')} FROM g GROUP BY 1) SELECT study_id, nn AS n_narrow, nw AS n_wide, round({_kappa('n')}, 6) + 0e0 AS narrow, round({_kappa('w')}, 6) + 0e0 AS wide FROM k")
def kappa_narrow_wide(spark, d):
    return agreement.agreement(agreement.matched(readings(spark, d)), vocabulary=WORDS).select("study_id", "n_narrow", "n_wide", _z("narrow").alias("narrow"), _z("wide").alias("wide"))


@query(f"WITH {_READ} SELECT study_id, label, prob, image_ref FROM (SELECT *, row_number() OVER (PARTITION BY study_id, label ORDER BY prob DESC, ord) AS k FROM r) WHERE k = 1")
def study_max_argmax(spark, d):
    return findings.argmax_by_label(readings(spark, d), ["study_id", "label"])


@query(f"""WITH {_READ}, h AS (SELECT *, row_number() OVER (PARTITION BY study_id, label ORDER BY prob DESC, ord) AS k FROM r WHERE prob >= 0.3 AND label IN ('error', 'purchase')),
  n AS (SELECT study_id, label, count(DISTINCT reader) AS n FROM h GROUP BY ALL)
  SELECT h.study_id, h.label, prob, CASE WHEN n > 1 THEN 'both' ELSE reader END AS source, image_ref FROM h JOIN n ON h.study_id = n.study_id AND h.label = n.label WHERE k = 1""")
def critical_triage(spark, d):
    return findings.triage(readings(spark, d).withColumnRenamed("reader", "source"), labels=CRITICAL)


@query(f"""WITH {_READ}, o AS (SELECT *, row_number() OVER (PARTITION BY study_id, label ORDER BY prob DESC, ord) AS k FROM r),
  t AS (SELECT study_id, label, prob, ord, CAST(row_number() OVER (PARTITION BY study_id ORDER BY prob DESC, ord) AS INTEGER) AS rank FROM o WHERE k = 1) SELECT * FROM t WHERE rank <= 3""")
def finding_dedup_cap(spark, d):
    return findings.dedup_and_cap(readings(spark, d), 3, F.lower(F.trim("label"))).select("study_id", "label", "prob", "ord", "rank")


def _disputes(spark, d):
    m = _merged(spark, d).where("kind <> 'agree'")
    return m.select(F.element_at(F.split("study_id", "-"), 1).alias("study_id"), F.concat_ws("/", "study_id", "label").alias("ord"), "label", "kind", "in_vocabulary", "a_prob", "b_prob")


_DISPUTE = f"""{_MATCH}, q AS (SELECT split_part(study_id, '-', 1) AS study_id, study_id || '/' || label AS ord, label, kind, in_vocabulary, a_prob, b_prob FROM g WHERE kind <> 'agree')"""


@query(f"""WITH {_DISPUTE} SELECT study_id, ord, kind, CAST(row_number() OVER w AS INTEGER) AS position, row_number() OVER w <= 12 AS funded FROM q
  WINDOW w AS (PARTITION BY study_id ORDER BY NOT in_vocabulary, kind = 'unique', ord)""")
def arbiter_budget_order(spark, d):
    return findings.budget(_disputes(spark, d)).select("study_id", "ord", "kind", "position", "funded")


@query(f"""WITH {_DISPUTE} SELECT ord, kind, CASE WHEN kind = 'unique' THEN 'UNCERTAIN' WHEN kind = 'magnitude' THEN 'CONFIRM' WHEN coalesce(greatest(a_prob, b_prob), 0) >= 0.6 THEN 'CONFIRM' ELSE 'REJECT' END AS verdict FROM q""")
def offline_arbiter_verdict(spark, d):
    return _disputes(spark, d).select("ord", "kind", findings.offline_verdict(F.col("kind"), F.col("a_prob"), F.col("b_prob")).alias("verdict"))


@query(f"""WITH {_READ}, p AS (SELECT * FROM (VALUES ('view', 0.7e0), ('error', 0.8e0), ('click', NULL), ('purchase', 0.2e0)) v(label, t))
  SELECT r.label, CASE WHEN r.label IN ('error', 'purchase') THEN least(coalesce(t, 0.5e0), 0.5e0) ELSE coalesce(t, 0.5e0) END AS threshold, t IS NOT NULL AS calibrated,
  count(*) AS n, count(*) FILTER (WHERE prob >= CASE WHEN r.label IN ('error', 'purchase') THEN least(coalesce(t, 0.5e0), 0.5e0) ELSE coalesce(t, 0.5e0) END) AS positive FROM r LEFT JOIN p ON r.label = p.label GROUP BY ALL""")
def calibrated_threshold_join(spark, d):
    points = spark.createDataFrame([("view", 0.7), ("error", 0.8), ("click", None), ("purchase", 0.2)], "label string, threshold double")
    rows = findings.with_thresholds(readings(spark, d), points, 0.5, CRITICAL)
    return rows.groupBy("label", "threshold", "calibrated").agg(F.count("*").alias("n"), F.count_if(F.col("prob") >= F.col("threshold")).alias("positive"))


_NAMES = ("Pleural_Effusion", "pleural effusion.", "RIB FRACTURE", "Fractures, Bone", "lung opacity", "unknown thing")


@query(f"""WITH w AS (SELECT event_id, [{", ".join(f"'{n}'" for n in _NAMES)}][1 + event_id % {len(_NAMES)}] AS raw FROM events),
  k AS (SELECT event_id, raw, regexp_replace(lower(raw), '[\\s_\\-.,;:!?''"()/]+', '', 'g') AS key FROM w)
  SELECT raw, v.label, count(*) AS n FROM k LEFT JOIN (VALUES {", ".join(f"('{k}', '{x}')" for k, x in text.LOOKUP.items())}) v(key, label) ON k.key = v.key GROUP BY ALL""")
def alias_canonical_join(spark, d):
    raw = F.get(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES)).cast("int"))
    return _t(spark, d, "events").select(raw.alias("raw"), text.canonical(raw, ascii_only=True).alias("label")).groupBy("raw", "label").agg(F.count("*").alias("n"))


def _cited(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("evidence_id"))


def _known(spark, d):
    return _t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("evidence_id"))


@query("""SELECT l_orderkey, l_linenumber, 'dangling' AS reason, list_sort(list(DISTINCT l_partkey)) AS dangling FROM lineitem
  WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY ALL""")
def evidence_violations(spark, d):
    return evidence.violations(_cited(spark, d), _known(spark, d), ["l_orderkey", "l_linenumber"])


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN p_partkey IS NULL THEN 0 ELSE 1 END) AS ok FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON l_partkey = p_partkey GROUP BY 1, 2)
  SELECT l_orderkey, count(*) AS claims, CAST(sum(ok) AS BIGINT) AS supported, round(sum(ok) * 1e0 / count(*), 6) AS coverage FROM s GROUP BY 1""")
def evidence_coverage(spark, d):
    return evidence.coverage(_cited(spark, d), _known(spark, d), "l_orderkey", ["l_linenumber"]).withColumn("coverage", _r("coverage"))


@query("""SELECT l_suppkey, list_sort(list_distinct(list(l_partkey) FILTER (WHERE p_partkey IS NOT NULL))) AS cited FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON l_partkey = p_partkey
  GROUP BY 1 HAVING count(p_partkey) > 0""")
def citation_filter_distinct(spark, d):
    return evidence.known_citations(_t(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("evidence_id")), _known(spark, d), ["l_suppkey"])


@query("""WITH o AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1), k AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS known FROM lineitem WHERE l_quantity > 20 GROUP BY 1)
  SELECT o.l_orderkey, list_filter([ids[i] FOR i IN range(1, len(ids) + 1) IF list_position(ids, ids[i]) = i], lambda x: list_contains(coalesce(known, []), x)) AS cited FROM o LEFT JOIN k ON o.l_orderkey = k.l_orderkey""")
def citations_in_order(spark, d):
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    of = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda x: x["l_partkey"]).alias("ids"), F.collect_set(F.when(F.col("l_quantity") > 20, F.col("l_partkey"))).alias("known"))
    return of.select("l_orderkey", evidence.known_only(F.col("ids"), F.col("known")).alias("cited"))


@query("""SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) AS claims FROM lineitem GROUP BY 1""")
def claim_sections(spark, d):
    section = F.when(F.col("l_returnflag") == "R", "findings").when(F.col("l_returnflag") == "A", "impression").otherwise("technique")
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(evidence.is_claim(section)).alias("claims"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 45 THEN l_partkey END AS id FROM lineitem),
  s AS (SELECT l_orderkey, l_linenumber, count(id) AS n, list_sort(coalesce(list(DISTINCT id) FILTER (WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)), [])) AS dangling FROM c GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, CASE WHEN n = 0 THEN 'no_evidence' ELSE 'dangling' END AS reason, dangling FROM s WHERE n = 0 OR len(dangling) > 0""")
def evidence_missing_or_dangling(spark, d):
    cited = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_quantity") <= 45, F.col("l_partkey")).alias("evidence_id"))
    return evidence.violations(cited, _known(spark, d), ["l_orderkey", "l_linenumber"])


@query("SELECT conv_id, list_sort(list_filter(['user', 'assistant', 'system'], lambda x: NOT list_contains(list(DISTINCT role), x))) AS missing FROM conversations GROUP BY 1")
def missing_sections(spark, d):
    return evidence.missing_sections(_t(spark, d, "conversations"), ("user", "assistant", "system"), "conv_id", "role")


@query(f"""WITH {_MATCH} SELECT study_id, label, a_prob, b_prob, kind, CASE WHEN kind = 'agree' THEN NULL WHEN kind = 'unique' THEN 'UNCERTAIN' WHEN kind = 'magnitude' THEN 'CONFIRM' WHEN coalesce(greatest(a_prob, b_prob), 0) >= 0.6 THEN 'CONFIRM' ELSE 'REJECT' END AS verdict FROM g""")
def dual_read_view(spark, d):
    m = _merged(spark, d).select("study_id", "label", "a_prob", "b_prob", "kind")
    verdicts = m.where("kind <> 'agree'").withColumn("verdict", findings.offline_verdict(F.col("kind"), F.col("a_prob"), F.col("b_prob")))
    return agreement.dual_view(m, verdicts)


@query("""WITH t AS (SELECT conv_id, string_agg(sha256(text), '|' ORDER BY turn, text) AS notes, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1)
  SELECT doc_id, quality, coalesce(n, 0) AS n_notes, sha256(coalesce(notes, '')) AS notes FROM labels LEFT JOIN t ON doc_id = conv_id""")
def describer_notes(spark, d):
    told = _t(spark, d, "conversations").where("role = 'assistant'").select(F.col("conv_id").cast("string").alias("study_id"), F.lit("note").alias("label"), "text", F.struct("turn", "text").alias("ord"))
    found = _t(spark, d, "labels").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("study_id"), F.lit("note").alias("label"), "quality", F.array().cast("array<string>").alias("notes"))
    out = agreement.describe(found, told)
    return out.select("doc_id", "quality", F.size("notes").cast("long").alias("n_notes"), F.sha2(F.array_join(F.transform("notes", lambda x: F.sha2(x, 256)), "|"), 256).alias("notes"))


@query("""SELECT doc_id, source, count(*) OVER () AS total FROM documents WHERE contains(lower(CAST(doc_id AS VARCHAR)), 'license') OR contains(lower(coalesce(text, '')), 'license') OR contains(lower(coalesce(source, '')), 'license')
  ORDER BY doc_id IN (10, 20, 30) DESC, doc_id LIMIT 20""")
def study_search_page(spark, d):
    docs = _t(spark, d, "documents")
    found = docs.where(search.matches(" License ", F.col("doc_id"), [F.col("text"), F.col("source")])).select("doc_id", "source")
    return search.page(found, [F.col("doc_id").isin(10, 20, 30).desc(), F.col("doc_id")], 20)


def _runs(spark, d):
    o = _t(spark, d, "orders")
    states = o.select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_custkey").cast("string").alias("study_id"), F.col("o_orderstatus").alias("status"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("created_at"),
        F.array_repeat(F.lit("x"), (F.col("o_orderkey") % 3).cast("int")).alias("alerts"), F.col("o_orderpriority").alias("budget_spent"), F.lit("secret").alias("raw_text"), F.lit("secret").alias("history"),
    )
    return store.record(states)


_RUN = """runs AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CAST(o_custkey AS VARCHAR) AS study_id, o_orderstatus AS status, CAST(floor(epoch(o_orderdate)) AS DOUBLE) AS created_at, CAST(o_orderkey % 3 AS INTEGER) AS alert_count, o_orderpriority AS spent FROM orders)"""


@query(f"WITH {_RUN} SELECT study_id, created_at, run_id, status FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY created_at DESC, run_id DESC) AS k FROM runs) WHERE k = 1")
def latest_run_per_study(spark, d):
    return store.newest_of_study(_runs(spark, d)).drop("payload")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_event_per_user(spark, d):
    return search.latest(_t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(f"WITH {_RUN} SELECT run_id, study_id, status, created_at, alert_count FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 50")
def run_newest_first(spark, d):
    return store.newest(_runs(spark, d), 50)


@query(f"WITH {_RUN} SELECT run_id, study_id, status, spent FROM runs WHERE run_id = '7'")
def run_point_lookup(spark, d):
    return store.get(_runs(spark, d), "7").select("run_id", "study_id", "status", F.get_json_object("payload", "$.budget_spent").alias("spent"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def order_point_lookup(spark, d):
    return search.point(_t(spark, d, "orders"), "o_orderkey", 7).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {_RUN} SELECT run_id, list_sort(['study_id', 'status', 'alerts', 'budget_spent']) AS fields FROM runs")
def allowlist_projection(spark, d):
    return _runs(spark, d).select("run_id", F.sort_array(F.json_object_keys("payload")).alias("fields"))


@query("""(SELECT doc_id, 'de' AS head FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 30) UNION ALL (SELECT doc_id, 'other' FROM documents WHERE lang <> 'de' ORDER BY doc_id LIMIT 20)""")
def corpus_head(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "de", "de").otherwise("other").alias("head"))
    return calibrate.head_limited(docs, F.col("head") == "de", [F.col("doc_id")], 30, 20)


@query("SELECT event_type, count(*) AS n FROM events WHERE NOT (event_type LIKE 'sign%' OR event_type LIKE 'vi%') GROUP BY 1")
def spans_without_prefix(spark, d):
    return search.without_prefixed(_t(spark, d, "events"), "event_type", ("sign", "vi")).groupBy("event_type").agg(F.count("*").alias("n"))


_META = ", ".join(f"'{x}'" for x in vocab.FILE_META_IDENTIFIERS)


@query(f"""SELECT o_orderkey, list_filter([{_META}], lambda k: (k = 'SourceApplicationEntityTitle' AND o_orderkey % 2 = 0) OR (k = 'ImplementationClassUID' AND o_orderstatus = 'F')) AS identifiers FROM orders""")
def file_meta_identifiers(spark, d):
    meta = F.create_map(F.lit("SourceApplicationEntityTitle"), F.when(F.col("o_orderkey") % 2 == 0, "PACS").otherwise(""), F.lit("ImplementationClassUID"), F.when(F.col("o_orderstatus") == "F", "1.2"), F.lit("TransferSyntaxUID"), F.lit("1.2.840"))
    return _t(spark, d, "orders").select("o_orderkey", search.meta_identifiers(meta).alias("identifiers"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['Modality', 'Rows'] ELSE ['Modality'] END AS kept, CASE WHEN o_orderstatus = 'F' THEN ['PatientID', 'PatientName'] ELSE ['PatientName'] END AS gone FROM orders""")
def dicom_tag_allowlist(spark, d):
    some = lambda k, v, when: F.when(when, F.create_map(F.lit(k), v)).otherwise(F.create_map().cast("map<string,string>"))
    tags = F.map_concat(F.create_map(F.lit("PatientName"), F.lit("X^Y"), F.lit("Modality"), F.lit("CR")), some("Rows", F.lit("9"), F.col("o_orderkey") % 2 == 0), some("PatientID", F.lit("1"), F.col("o_orderstatus") == "F"))
    kept, gone = search.allowed_tags(tags)
    return _t(spark, d, "orders").select("o_orderkey", F.sort_array(F.map_keys(kept)).alias("kept"), gone.alias("gone"))


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size * 10 < 128 THEN 'low_resolution' END, CASE WHEN p_size % 12 < 5 THEN 'low_contrast' END, CASE WHEN NOT (p_retailprice / 5 BETWEEN 15 AND 235) THEN 'exposure' END, CASE WHEN p_size / 50e0 < 0.5 THEN 'asymmetric' END], lambda x: x IS NOT NULL) AS issues,
  NOT (p_size * 10 < 128 OR p_size % 12 < 5) AS ok FROM part""")
def image_quality(spark, d):
    issues, ok = search.qc_issues(F.col("p_size") * 10, F.lit(512), F.col("p_size") % 12, F.col("p_retailprice") / 5, F.col("p_size") / F.lit(50.0))
    return _t(spark, d, "part").select("p_partkey", issues.alias("issues"), ok.alias("ok"))


def _films(spark, d):
    return readings(spark, d).withColumn("locus", F.when(F.col("ord") % 3 == 0, F.struct(F.col("ord").cast("double").alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.1).alias("r"))))


@query(f"""WITH {_READ}, s AS (SELECT study_id, min(image_ref) AS image_path FROM r GROUP BY 1) SELECT r.study_id, list_sort(coalesce(list(r.label || ' ' || CAST(ord AS VARCHAR)) FILTER (WHERE image_ref = image_path), [])) AS loci, count(*) FILTER (WHERE image_ref <> image_path) AS n_elsewhere
  FROM r JOIN s ON r.study_id = s.study_id WHERE ord % 3 = 0 GROUP BY 1""")
def loci_on_displayed_film(spark, d):
    rows = _films(spark, d)
    found = findings.on_film(rows, rows.groupBy("study_id").agg(F.min("image_ref").alias("image_path")))
    return found.select("study_id", F.sort_array(F.transform("loci", lambda x: F.concat_ws(" ", x["label"], x["locus"]["cx"].cast("long").cast("string")))).alias("loci"), "n_elsewhere")


@query(f"""WITH {_READ}, e AS (SELECT study_id, label, arg_max(prob, ord) AS prob FROM r GROUP BY ALL) SELECT study_id, list_sort(list('cnn:' || label || ' ' || CAST(CAST(round(prob * 1000000) AS BIGINT) AS VARCHAR))) AS entries FROM e GROUP BY 1""")
def evidence_map(spark, d):
    rows = readings(spark, d).withColumn("source", F.lit("cnn")).withColumn("evidence_id", findings.evidence_id(F.col("source"), F.col("label"), F.lit("")))
    entry = lambda e: F.concat_ws(" ", e["key"], F.round(e["value"]["prob"] * 1_000_000).cast("long").cast("string"))
    return findings.evidence_map(rows).select("study_id", F.sort_array(F.transform(F.map_entries("evidence"), entry)).alias("entries"))


@query(f"""WITH {_READ}, x AS (SELECT study_id, CASE WHEN ord % 5 = 0 THEN ' ' ELSE label END AS label FROM r), c AS (SELECT study_id, count(*) FILTER (WHERE trim(label) = '') AS n_blank, greatest(0, count(DISTINCT label) FILTER (WHERE trim(label) <> '') - 2) AS n_capped FROM x GROUP BY 1)
  SELECT *, n_blank + n_capped AS dropped FROM c""")
def dropped_findings(spark, d):
    rows = readings(spark, d).withColumn("label", F.when(F.col("ord") % 5 == 0, " ").otherwise(F.col("label")))
    return findings.dropped(rows, 2, F.lower(F.trim("label")))


@query("SELECT event_id, least(greatest(value / 100e0, 0e0), 1e0) AS prob FROM events")
def clamped_probs(spark, d):
    return _t(spark, d, "events").select("event_id", findings.valid_prob(findings.clamp(F.col("value") / 100e0)).alias("prob"))


@query("""SELECT study_id, path, CAST(row_number() OVER (PARTITION BY study_id ORDER BY view <> 'frontal', round(symmetry, 6) DESC, path) AS INTEGER) AS rank
  FROM (SELECT CAST(l_orderkey AS VARCHAR) AS study_id, l_linenumber || '-' || l_partkey AS path, CASE WHEN l_returnflag = 'R' THEN 'lateral' ELSE 'frontal' END AS view, l_discount AS symmetry FROM lineitem)""")
def film_rank(spark, d):
    l = _t(spark, d, "lineitem")
    views = l.select(F.col("l_orderkey").cast("string").alias("study_id"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("path"), F.when(F.col("l_returnflag") == "R", "lateral").otherwise("frontal").alias("view"), F.col("l_discount").alias("symmetry"))
    return findings.ranked_films(views).select("study_id", "path", "rank")


@query("SELECT l_orderkey, l_linenumber, nullif(CAST(l_quantity AS BIGINT) % 7, 0) AS input, nullif(CAST(l_quantity AS BIGINT) % 5, 0) AS output, nullif(CASE WHEN l_linenumber > 3 THEN CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) % 7 + CAST(l_quantity AS BIGINT) % 5 END, 0) AS total FROM lineitem")
def token_totals(spark, d):
    q = F.col("l_quantity").cast("long")
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.token_totals(q % 7, q % 5, F.when(F.col("l_linenumber") > 3, q)).alias("t")).select("l_orderkey", "l_linenumber", "t.input", "t.output", "t.total")


@query("""SELECT page_id, '[MASKED text/html · sha256:' || substr(sha256(html), 1, 12) || ' · ' || page_id || '.html]' AS reference FROM pages""")
def film_reference(spark, d):
    pages = _t(spark, d, "pages")
    return pages.select("page_id", text.film_reference(F.concat(F.lit("x/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html").cast("binary")).alias("reference"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'system' THEN 2 ELSE 1 END AS messages, sha256(text) AS prompt, '[MASKED image/png · sha256:unreadable · f.png]' AS url FROM conversations""")
def traced_request(spark, d):
    ref = text.film_reference(F.lit("d/f.png"), F.lit(None).cast("binary"))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.from_json(text.generation_input(F.col("text"), ref, F.when(F.col("role") == "system", "be brief").otherwise("")), "array<string>").alias("m"))
    last = lambda path: F.get_json_object(F.element_at("m", -1), path)
    return rows.select("conv_id", "turn", F.size("m").alias("messages"), F.sha2(last("$.content[0].text"), 256).alias("prompt"), last("$.content[1].image_url.url").alias("url"))


@query("SELECT event_id, [event_type, CAST(user_id AS VARCHAR), 'x'] AS leaves FROM events")
def payload_string_leaves(spark, d):
    doc = F.to_json(F.struct("event_type", F.struct(F.array(F.col("user_id").cast("string"), F.lit("x")).alias("deep"), "value").alias("inner"), "event_id"))
    return _t(spark, d, "events").select("event_id", text.string_leaves(doc).alias("leaves"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 7 = 0 THEN 'specificity 0.9 only: no positives' WHEN l_linenumber % 7 * 10 < 25 THEN 'specificity 0.9: few positives (n=' || l_linenumber % 7 * 10 || ')' ELSE 'specificity 0.9 (n=' || l_linenumber % 7 * 10 || ')' END || CASE WHEN l_returnflag = 'R' THEN '; alert candidate' ELSE '' END AS rule FROM lineitem")
def threshold_rule_text(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", calibrate.rule_text(F.col("l_linenumber") % 7 * 10, 0.9, F.col("l_returnflag") == "R").alias("rule"))


# An engine without lookaround runs the same rules without it: the greedy runs of digits start and end where the lookarounds ask. Letters and digits of all scripts stand for Unicode word characters.
_RED = [(p.replace(r"(?<!\d)", "").replace(r"(?!\d)", "").replace(r"[\w.+-]", r"[\p{L}\p{N}_.+-]").replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"[\w.-]", r"[\p{L}\p{N}_.-]"), to) for p, to in rules.REDACTIONS]


def _chain(c: str, pairs: list[tuple[str, str]]) -> str:
    for p, to in pairs:
        c = f"regexp_replace({c}, '{p}', '{to}', 'g')"
    return c


@query(f"""SELECT doc_id, sha256({_chain("text", _RED)}) AS clean, {_chain("text", _RED)} <> text AS changed FROM documents""")
def redact_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("clean"), "text").select("doc_id", F.sha2("clean", 256).alias("clean"), (F.col("clean") != F.col("text")).alias("changed"))


def _scrub_sql(table: str, keys: str) -> str:
    """The rules for identifiers one after the other, for an engine without lookarounds: what stands beside a value is matched and put back, twice, as two values may share it.

    Left out is the one rule that looks ahead inside its value (surnames in Chinese after a label), which these tables don't meet.
    """
    left, right, edge = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])", "[^0-9A-Za-z]"
    steps = [f"s0 AS (SELECT {keys}, text AS source, coalesce(text, '') AS t, '' AS f FROM {table})"]
    for kind, value, context in rules.IDENTIFIERS:
        inner = value.removeprefix(left).removesuffix(right)
        if "(?=" in inner:
            continue
        # a bounded value after a context needs no left edge: every context ends with a blank, a colon or nothing in a word
        before = f"({context})" if context else f"(^|{edge})" if value.startswith(left) else "()"
        after = f"($|{edge})" if value.endswith(right) else "()"
        pattern = f"{before}(?:{inner})".replace("'", "''") + after
        sub = lambda t: rf"regexp_replace({t}, '{pattern}', '\1[REDACTED:{kind}]\2', 'g')"  # noqa: B023, E731
        steps.append(f"s{len(steps)} AS (SELECT {keys}, source, {sub(sub('t'))} AS t, f || CASE WHEN regexp_matches(t, '{pattern}') THEN ',{kind}' ELSE '' END AS f FROM s{len(steps) - 1})")
    return f"WITH {', '.join(steps)} SELECT {keys}, CASE WHEN f = '' THEN [] ELSE string_split(f[2:], ',') END AS fired, sha256(source) AS before, sha256(t) AS after FROM s{len(steps) - 1}"


@query(_scrub_sql("conversations", "conv_id, turn"))
def scrub_text(spark, d):
    rows = _t(spark, d, "conversations").withColumn("s", text.scrubbed(F.col("text")))
    return rows.select("conv_id", "turn", F.col("s.fired").alias("fired"), F.sha2(F.col("text"), 256).alias("before"), F.sha2(F.col("s.now"), 256).alias("after"))


_RE2 = [(p.replace("(?i)", ""), c) for p, c in rules.ATTACKS]


@query(f"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS s FROM conversations)
  SELECT conv_id, turn, CASE {" ".join(f"WHEN regexp_matches(s, '{p}', 'i') THEN '{c}'" for p, c in _RE2)} ELSE '' END AS category FROM t""")
def detect_injection_category(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.injection_category(F.col("text"), nfkc=False).alias("category"))


@query()
def detect_injection_category_nfkc(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.injection_category(F.col("text")).alias("category"))


_ASCII_RED = [(k, p) for k, p in rules.REDLINES if p.isascii() and "(?!" not in p]


@query(f"""SELECT doc_id, {", ".join(f"CAST({' + '.join(f"len(regexp_extract_all(text, '(?i){p}'))" for k2, p in _ASCII_RED if k2 == k)} AS INTEGER) AS {k}" for k in ("diagnostic", "exclusion", "treatment"))} FROM documents""")
def redline_counts(spark, d):
    found = _t(spark, d, "documents").select("doc_id", text.redlines(F.col("text")).alias("r"))
    n = lambda k: F.size(F.filter("r", lambda x: x["kind"] == k)).alias(k)
    return found.select("doc_id", *map(n, ("diagnostic", "exclusion", "treatment")))


@query(f"""SELECT doc_id, sha256({_chain("text", list(rules.NEUTRAL))}) AS clean FROM documents""")
def neutral_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(text.neutral(F.col("text")), 256).alias("clean"))


@query(f"""WITH t AS (SELECT doc_id, unnest([{", ".join(f"{{'k': '{k}', 'm': regexp_extract_all(text, '(?i){p}'), 'g': string_split_regex(text, '(?i){p}')}}" for k, p in rules.REDLINES if "(?!" not in p)}]) AS x FROM documents WHERE text IS NOT NULL),
  s AS (SELECT doc_id, x.k AS kind, CAST(list_sum([len(x.g[j]) FOR j IN range(1, i + 1)]) + coalesce(list_sum([len(x.m[j]) FOR j IN range(1, i)]), 0) AS INTEGER) AS start, len(x.m[i]) AS n FROM t, unnest(range(1, len(x.m) + 1)) u(i))
  SELECT doc_id, kind, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(sum(start + n) AS BIGINT) AS ends FROM s GROUP BY 1, 2""")
def redline_spans(spark, d):
    found = _t(spark, d, "documents").select("doc_id", F.explode(text.redlines(F.col("text"))).alias("r"))
    return found.groupBy("doc_id", "r.kind").agg(F.count("*").alias("n"), F.sum("r.start").alias("starts"), F.sum("r.end").alias("ends"))


@query(r"""WITH a AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: NOT contains(x, 'the') AND x <> '') AS w FROM documents),
  b AS (SELECT *, list_position(list_transform(w, lambda x: lower(trim(x, '.,;:')) IN ('and', 'or', 'but')), false) AS k FROM a), c AS (SELECT doc_id, text, CASE WHEN coalesce(k, 0) = 0 THEN [] ELSE w[k:] END AS w FROM b),
  e AS (SELECT *, list_position(list_transform(w, lambda x: regexp_matches(x, '[\p{L}\p{N}]')), true) AS k FROM c), f AS (SELECT doc_id, text, trim(regexp_replace(array_to_string(CASE WHEN coalesce(k, 0) = 0 THEN [] ELSE w[k:] END, ' '), '\s+([.,;:])', '\1', 'g')) AS t FROM e)
  SELECT doc_id, sha256(CASE WHEN NOT contains(text, 'the') THEN text WHEN regexp_matches(t, '[\p{L}\p{N}]') THEN t ELSE '' END) AS clean FROM f""")
def xxxx_token_drop(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(text.drop_marked(F.col("text"), "the"), 256).alias("clean"))


@query("""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[.;,\n。；，]+'), lambda x: trim(regexp_replace(x, '^\\s*(?:\\d+[.)]|[-•])\\s*', ''), ' ')), lambda x: x <> '')) AS INTEGER) AS n FROM documents""")
def clause_segments(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(text.segments(F.col("text"))).alias("n"))


@query("""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*the [^.!?]*')) AS s FROM documents), l AS (SELECT doc_id, lower(s) AS s FROM s)
  SELECT doc_id, CASE WHEN contains(substr(s, 1, strpos(s, 'the ') - 1) || ' ', 'no ') OR contains(substr(s, 1, strpos(s, 'the ') - 1) || ' ', 'without') THEN 'negated' ELSE 'affirmed' END AS class, count(*) AS n FROM l GROUP BY ALL""")
def keyword_negation_class(spark, d):
    s = _t(spark, d, "documents").select("doc_id", F.explode(F.filter(F.split("text", "[.!?]"), lambda s: s.contains("the "))).alias("s"))
    kind = text.mention_class(F.col("s"), F.lit("the "))
    return s.select("doc_id", F.when(kind == "negated", "negated").otherwise("affirmed").alias("class")).groupBy("doc_id", "class").agg(F.count("*").alias("n"))


@query(f"""SELECT conv_id, turn, CASE {" ".join(f"WHEN contains(lower(trim(text)), '{w.replace(chr(39), chr(39) * 2)}') THEN {p}e0" for w, p in sorted(((w, p) for p, ws in vocab.CONFIDENCE.items() for w in ws), key=lambda x: -len(x[0])))} ELSE 0.3e0 END AS p FROM conversations""")
def confidence_bucket(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.confidence(F.col("text")).alias("p"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs FROM pages""")
def html_text_scan(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"))


@query("SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) AND b.text <> '' GROUP BY 1")
def payload_leak_scan(spark, d):
    truths = _t(spark, d, "benchmark").select("item_id", F.col("text").alias("value"))
    hits = retrieval.contains_join(_t(spark, d, "documents").select("doc_id", "text"), "text", truths, "value")
    return hits.groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


_F64 = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(f"""WITH v AS (SELECT vec_id, {_F64} AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.e, d.e), 6) AS sim FROM v q JOIN v d ON q.vec_id % 100 = 0)
  SELECT query_id, doc_id, sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM s) WHERE rank <= 3""")
def vector_topk(spark, d):
    v = _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    docs = v.select(F.col("vec_id").alias("doc_id"), F.col("e").alias("d"), F.col("vec_id").alias("ord"))
    return retrieval.top_k(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q")), docs, 3, 6)


@query(r"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM benchmark), b AS (SELECT item_id, CAST(('0x' || right(md5(w), 2)) AS INTEGER) AS bucket, count(*) * 1e0 AS n FROM w GROUP BY ALL)
  SELECT item_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 6) AS weight FROM b""")
def hash_embed(spark, d):
    return retrieval.hashed_words(_t(spark, d, "benchmark"), "item_id", "text").withColumn("weight", _r("weight"))


@query(r"""WITH w AS (SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents UNION ALL SELECT 'q', item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) FROM benchmark),
  b AS (SELECT side, id, CAST(('0x' || right(md5(w), 2)) AS INTEGER) AS bucket, count(*) * 1e0 AS n FROM w GROUP BY ALL), v AS (SELECT side, id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY side, id)) AS weight FROM b),
  s AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.weight * d.weight), 9) AS sim FROM v q JOIN v d USING (bucket) WHERE q.side = 'q' AND d.side = 'd' GROUP BY 1, 2),
  a AS (SELECT item_id AS query_id, documents.doc_id AS doc_id, coalesce(sim, 0) AS sim FROM benchmark CROSS JOIN documents LEFT JOIN s ON s.query_id = item_id AND s.doc_id = documents.doc_id)
  SELECT query_id, a.doc_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rank FROM a) a WHERE rank <= 5""")
def indexed_retrieval_topk(spark, d):
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = _t(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ord"), "text")
    return retrieval.top_k_words(asked, docs, 5, 9).withColumn("sim", _r("sim"))


@query("SELECT conv_id, turn, CAST(length(text) AS VARCHAR) || ':' || left(text, 3) AS reply, false AS failed FROM conversations")
def ledger_replies(spark, d):
    """Replies of a stand-in that is asked through a ledger: each different text once."""
    rows = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    kept = ledger.Ledger(spark, session.scratch(spark, "ledger"), shards=16, batch=64)
    said = kept.answered(rows, lambda prompts, paths: [f"{len(p)}:{p[:3]}" for p in prompts], F.col("text"), F.lit(""))
    return said.select("conv_id", "turn", F.col("said.reply").alias("reply"), F.col("said.error").isNotNull().alias("failed"))


@query("""SELECT CAST(user_id AS VARCHAR) AS study_id, event_type AS channel, count(*) AS n, count(DISTINCT event_id % 3) AS writers, sha256(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id % 3, event_id)) AS items FROM events GROUP BY 1, 2""")
def run_channels(spark, d):
    """Events as updates of three writers to their users' channels, through the keyed state of a stream."""
    stream = feed.events(spark, f"{d}/events.parque[t]")  # a pattern, as the table may be a file, which streams don't take
    updates = stream.select(F.col("user_id").cast("string").alias("study_id"), F.col("event_type").alias("channel"), (F.col("event_id") % 3).cast("string").alias("writer"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("item"))
    at = session.scratch(spark, "channels")
    feed.drain(channels.once_a_batch(channels.channels(updates, "3650 days"), f"{at}/out", f"{at}/checkpoint"))
    got = spark.read.schema(channels.CHANGE).parquet(f"{at}/out").where("kind = 'appended'").withColumn("seq", F.col("seq").cast("long"))
    items = F.transform(F.sort_array(F.collect_list(F.struct("ts", "writer", "seq", "item"))), lambda x: x["item"])
    return got.groupBy("study_id", "channel").agg(F.count("*").alias("n"), F.count_distinct("writer").alias("writers"), F.sha2(F.array_join(items, ","), 256).alias("items"))


@query("SELECT CAST(page_id AS VARCHAR) AS member, true AS complete, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages")
def archive_members(spark, d):
    """Every page through a compressed archive and back by the data source."""
    at = session.scratch(spark, "archives")
    archives.write(_t(spark, d, "pages"), at, "page_id", "html")
    return archives.films(spark, at, "member", "size", "complete", "content").select("member", "complete", "size", F.sha2("content", 256).alias("digest"))


def _scored(spark, d):
    return _t(spark, d, "embeddings").select("label", F.get("embedding", F.lit(0)).cast("double").alias("score"), (F.col("label") < 3).alias("positive"))


@query("""WITH s AS (SELECT round(CAST(embedding[1] AS DOUBLE), 1) AS score, label < 3 AS positive FROM embeddings), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2e0 AS r FROM s)
  SELECT round((sum(r) FILTER (WHERE positive) - count(*) FILTER (WHERE positive) * (count(*) FILTER (WHERE positive) + 1) / 2e0) / (count(*) FILTER (WHERE positive) * count(*) FILTER (WHERE NOT positive)), 6) AS auc FROM r""")
def auc_rank_sum(spark, d):
    return calibrate.auc(_scored(spark, d).withColumn("score", _r("score", 1)), []).select(_r("auc").alias("auc"))


def _qualities(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select("lang", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive"))


_Q = "q AS (SELECT lang, CAST(n_chars AS DOUBLE) AS score, quality = 1 AS positive FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {_Q}, n AS (SELECT lang, list_sort(list(score)) AS s FROM q WHERE NOT positive GROUP BY 1) SELECT lang, s[1 + CAST(least(len(s) - 1, round_even(0.9e0 * len(s), 0)) AS BIGINT)] AS threshold FROM n")
def threshold_at_specificity(spark, d):
    return calibrate.threshold_at_specificity(_qualities(spark, d).where("NOT positive"), ["lang"], 0.9)


@query(f"WITH {_Q}, n AS (SELECT lang, list_sort(list(score)) AS s FROM q WHERE positive GROUP BY 1) SELECT lang, s[1 + CAST(greatest(0, round_even((1 - 0.9e0) * len(s), 0) - 1) AS BIGINT)] AS threshold FROM n")
def threshold_at_sensitivity(spark, d):
    return calibrate.threshold_at_sensitivity(_qualities(spark, d).where("positive"), ["lang"], 0.9)


@query(f"""WITH {_Q}, n AS (SELECT lang, list_sort(list(score)) AS s FROM q WHERE NOT positive GROUP BY 1), t AS (SELECT lang, s[1 + CAST(least(len(s) - 1, round_even(0.9e0 * len(s), 0)) AS BIGINT)] AS threshold FROM n)
  SELECT lang, threshold, round(avg(CASE WHEN NOT positive THEN CASE WHEN score < threshold THEN 1e0 ELSE 0e0 END END), 4) AS specificity, round(avg(CASE WHEN positive THEN CASE WHEN score >= threshold THEN 1e0 ELSE 0e0 END END), 4) AS sensitivity,
  round(avg(CASE WHEN NOT positive THEN CASE WHEN score >= 0.5 THEN 1e0 ELSE 0e0 END END), 4) AS positive_rate_at_half, count(*) FILTER (WHERE positive) AS n_pos, count(*) FILTER (WHERE NOT positive) AS n_neg FROM q JOIN t USING (lang) GROUP BY 1, 2""")
def operating_points(spark, d):
    q = _qualities(spark, d)
    return calibrate.rates(q, calibrate.threshold_at_specificity(q.where("NOT positive"), ["lang"], 0.9), ["lang"])


@query("""WITH x AS (SELECT doc_id, toxic, n_chars > 1500 AS hit, lang FROM labels JOIN documents USING (doc_id))
  SELECT lang, count(*) FILTER (WHERE toxic = 1) AS n, count(*) FILTER (WHERE toxic = 1 AND hit) AS hits, round(count(*) FILTER (WHERE toxic = 1 AND hit) * 1e0 / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS recall,
  round(count(*) FILTER (WHERE toxic = 0 AND hit) * 1e0 / nullif(count(*) FILTER (WHERE toxic = 0), 0), 6) AS false_positive_rate FROM x GROUP BY GROUPING SETS ((lang), ())""")
def gold_recall_fpr(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("study_id"), F.col("lang").alias("label"), "n_chars")
    cases = _t(spark, d, "labels").select(F.col("doc_id").alias("study_id"), (F.col("toxic") == 1).alias("expected")).join(docs, "study_id")
    of = gates.recall_by_label(cases, docs.where("n_chars > 1500"))
    return of.select(F.col("label").alias("lang"), "n", "hits", _r("recall").alias("recall"), _r("false_positive_rate").alias("false_positive_rate"))


@query(f"""WITH {_MATCH}, c AS (SELECT count(*) AS n, bool_and(abs(coalesce(a_prob, b_prob)) <= 1) AS ok FROM m), lb AS (SELECT count(*) AS n, bool_and(quality IN (0, 1)) AS ok FROM labels), p AS (SELECT count(*) AS n, bool_and(p_size <= 40) AS ok FROM part),
  s AS (SELECT 'bounds' AS suite, true AS hard, n, ok AND n >= 10 AS passed FROM c UNION ALL SELECT 'labels', true, n, ok AND n >= 10 FROM lb UNION ALL SELECT 'parts', true, n, ok AND n >= 10 FROM p)
  SELECT list_sort(list(suite) FILTER (WHERE hard AND NOT passed)) AS hard_failures, bool_and(passed) FILTER (WHERE hard) AS gate_pass FROM s""")
def gate_rollup(spark, d):
    m = agreement.matched(readings(spark, d))
    of = lambda rows, name, ok: gates.suite(rows, name, True, {"ok": F.bool_and(ok).cast("int")}, F.col("ok") == 1)
    rows = of(m, "bounds", F.abs(F.coalesce("a_prob", "b_prob")) <= 1).union(of(_t(spark, d, "labels"), "labels", F.col("quality").isin(0, 1))).union(of(_t(spark, d, "part"), "parts", F.col("p_size") <= 40))
    return gates.rollup(gates.with_least(rows, 10))


@query("""SELECT CAST(user_id AS VARCHAR) AS study_id, CASE WHEN count(*) >= 2 THEN round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000e0, 1) END AS latency_ms,
  min(ts) FILTER (WHERE event_type = 'error') < min(ts) FILTER (WHERE event_type = 'purchase') AS alert_first FROM events GROUP BY 1""")
def trace_latency_order(spark, d):
    node = F.when(F.col("event_type") == "error", "critical_triage").when(F.col("event_type") == "purchase", "report_writer").otherwise(F.col("event_type"))
    trace = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("study_id"), node.alias("node"), (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"))
    return studies.timeline(trace).withColumn("latency_ms", F.round("latency_ms", 1))


@query("SELECT event_type, round(avg(CASE WHEN value / 100e0 >= 0.5 THEN 1e0 ELSE 0e0 END), 6) AS positive_rate, count(*) AS n FROM events GROUP BY 1")
def weak_label_positive_rate(spark, d):
    return _t(spark, d, "events").groupBy("event_type").agg(_r(F.avg((F.col("value") / 100e0 >= 0.5).cast("double"))).alias("positive_rate"), F.count("*").alias("n"))


@query("SELECT user_id, round(avg(value) FILTER (WHERE event_type <> 'view'), 4) AS mean_delta FROM events GROUP BY 1")
def excluding_target_mean(spark, d):
    deltas = _t(spark, d, "events").select("user_id", F.col("event_type").alias("label"), F.col("value").alias("delta"))
    return calibrate.mean_delta_excluding(deltas, "view", ["user_id"]).withColumn("mean_delta", _r("mean_delta", 4))


@query("SELECT user_id, arg_max(event_type, (value, -event_id)) AS top FROM events GROUP BY 1")
def argmax_label(spark, d):
    return calibrate.argmax_label(_t(spark, d, "events").select("user_id", F.col("event_type").alias("label"), F.col("value").alias("score"), F.col("event_id").alias("ord")), ["user_id"])


@query(f"""WITH {_MATCH}, k AS (SELECT study_id, {_counts('true', 'w')}, count(*) FILTER (WHERE kind <> 'agree') AS dis FROM g GROUP BY 1), s AS (SELECT round(avg({_kappa('w')}), 6) AS mean_kappa, round(avg(CASE WHEN dis > 0 THEN 1e0 ELSE 0e0 END), 6) AS disagreeing_share FROM k)
  SELECT *, CASE WHEN mean_kappa >= 0.4 AND disagreeing_share <= 0.4 THEN 'reader' ELSE 'describer' END AS decision FROM s""")
def peer_or_describer(spark, d):
    m = _merged(spark, d)
    of = agreement.kappa(m).join(m.groupBy("study_id").agg(F.count_if(F.col("kind") != "agree").alias("n_disagreements")), "study_id")
    return calibrate.keep_as_peer(of).withColumns({"mean_kappa": _r("mean_kappa"), "disagreeing_share": _r("disagreeing_share")})


@query(f"""WITH {_MATCH}, k AS (SELECT study_id, {_counts('true', 'w')}, count(*) FILTER (WHERE kind <> 'agree') AS dis FROM g GROUP BY 1), a AS (SELECT study_id, count(DISTINCT label) AS n FROM r WHERE prob >= 0.3 AND label IN ('error', 'purchase') GROUP BY 1),
  s AS (SELECT k.study_id, CAST(coalesce(n, 0) AS DOUBLE) AS alerts, CAST(least(dis, 12) AS DOUBLE) AS calls, CAST(dis AS DOUBLE) AS needs_human, CAST(dis AS DOUBLE) AS disagreements, CASE WHEN nw > 1 THEN round({_kappa('w')}, 6) + 0e0 END AS kappa FROM k LEFT JOIN a ON k.study_id = a.study_id)
  SELECT study_id, name, value FROM (UNPIVOT s ON alerts, calls, needs_human, disagreements, kappa INTO NAME name VALUE value)""")
def trace_scores(spark, d):
    m = _merged(spark, d)
    alerts = findings.triage(readings(spark, d).withColumnRenamed("reader", "source"), labels=CRITICAL).groupBy("study_id").agg(F.collect_list("label").alias("alerts"))
    dis = m.groupBy("study_id").agg(F.collect_list(F.when(F.col("kind") != "agree", F.struct("label", F.lit(True).alias("needs_human")))).alias("findings"))
    k = agreement.kappa(m).select("study_id", F.when(F.col("n_labels") > 1, _z("kappa")).alias("kappa"))
    states = k.join(dis, "study_id").join(alerts, "study_id", "left")
    states = states.select("study_id", F.coalesce("alerts", F.array().cast("array<string>")).alias("alerts"), F.least(F.size("findings"), F.lit(12)).alias("budget_spent"), "findings", F.col("findings").alias("disagreements"), "kappa")
    return studies.scores(states)


_FRAGMENTS = ("Small left pleural effusion.", "no pneumothorax; cardiomegaly", "Rib fracture, unclear thing.", "- Pneumonia", "normal")
_FOUND = ([("PleuralEffusion", True)], [("Cardiomegaly", True)], [("Fracture", True), ("unclear thing", False)], [("Pneumonia", True)], [])


@query(f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"({i}, {j}, '{label}', {str(mapped).lower()})" for i, rows in enumerate(_FOUND) for j, (label, mapped) in enumerate(rows))}) t(k, ord, label, mapped))
  SELECT event_id, ord, label, mapped FROM events JOIN v ON event_id % {len(_FRAGMENTS)} = k""")
def offline_second_reader(spark, d):
    said = F.get(F.array(*map(F.lit, _FRAGMENTS)), (F.col("event_id") % len(_FRAGMENTS)).cast("int"))
    return _t(spark, d, "events").select("event_id", F.posexplode(models.offline_reader_b(said)).alias("ord", "f")).select("event_id", "ord", "f.label", "f.mapped")


_REPLIES = ('[{"label": "Cardiomegaly", "confidence": "likely"}, "junk", {"label": "no mass"}]', 'So: ```json\nsee {0-9} [{"label": "Mass", "confidence": 0.7}]\n```', '{"findings": [{"label": "hernia", "confidence": "certain", "severity": "mild"}, 3]}', "nothing")
_PARSED = ([("Cardiomegaly", 0.6)], [("Mass", 0.7)], [("Hernia", 0.9)], [])


@query(f"""WITH v AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{label}', {p}e0)" for i, rows in enumerate(_PARSED) for label, p in rows)}) t(k, label, prob)) SELECT event_id, label, prob FROM events JOIN v ON event_id % {len(_REPLIES)} = k""")
def findings_of_replies(spark, d):
    reply = F.get(F.array(*map(F.lit, _REPLIES)), (F.col("event_id") % len(_REPLIES)).cast("int"))
    return _t(spark, d, "events").select("event_id", F.inline(replies.findings(reply))).select("event_id", "label", "prob")


_GIVEN, _FREE = ("confirm", "REJECT ", "maybe"), ("I Confirm that, though others reject it", "others (reject)", "preconfirmed, unrejected")


@query(rf"""WITH r AS (SELECT conv_id, turn, upper(trim(({[*_GIVEN]})[1 + conv_id % 3])) AS given, upper(CASE WHEN turn % 3 = 1 THEN text || ' ' || ({[*_FREE]})[1 + conv_id % 3] ELSE text END) AS said FROM conversations)
  SELECT conv_id, turn, CASE WHEN turn % 3 = 0 AND given IN ('CONFIRM', 'REJECT') THEN given WHEN regexp_matches(said, '\bCONFIRM\b') THEN 'CONFIRM' WHEN regexp_matches(said, '\bREJECT\b') THEN 'REJECT' ELSE 'UNCERTAIN' END AS verdict FROM r""")
def verdict_of_replies(spark, d):
    """Replies made of each turn's text: an object with a verdict and the text as its reasoning, the text with a judgment after it, or the text alone."""
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (F.col("conv_id") % 3).cast("int"))
    whole = F.concat(F.lit("Well: "), F.to_json(F.struct(pick(_GIVEN).alias("verdict"), F.col("text").alias("reasoning"))))
    said = F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, F.concat_ws(" ", "text", pick(_FREE))).otherwise(F.col("text"))
    return _t(spark, d, "conversations").select("conv_id", "turn", replies.verdict(said).alias("verdict"))


@query(f"""WITH {_READ}, e AS (SELECT study_id, label, max(least(floor(prob * 100 + 1e-9), 100)) / 100e0 AS prob FROM r GROUP BY 1, 2),
  f AS (SELECT study_id, string_agg('findings|' || label || CASE WHEN prob >= 0.5 THEN printf('{models.POSITIVE_LINE[2:]}', prob) ELSE printf('{models.NEGATIVE_LINE[2:]}', prob) END || '|cnn:' || label, chr(10) ORDER BY label) AS lines,
    string_agg(label, '{models.IMPRESSION[1]}' ORDER BY label) FILTER (WHERE prob >= 0.5) AS named, string_agg('cnn:' || label, ',' ORDER BY label) FILTER (WHERE prob >= 0.5) AS cited, string_agg('cnn:' || label, ',' ORDER BY label) AS ids FROM e GROUP BY 1)
  SELECT study_id, sha256('technique|{models.TECHNIQUE}|' || chr(10) || lines || chr(10) || 'impression|' || CASE WHEN named IS NULL THEN '{models.NEGATIVE}|' || ids ELSE '{models.IMPRESSION[0]}' || named || '{models.IMPRESSION[2]}|' || cited END || chr(10) || 'recommendation|{models.RECOMMENDATION}|' || ids) AS report, named IS NOT NULL AS positive FROM f""")
def offline_report(spark, d):
    """The whole report of each study over what was read of it."""
    best = readings(spark, d).groupBy("study_id", "label").agg((F.max(F.least(F.floor(F.col("prob") * 100 + 1e-9), F.lit(100))) / F.lit(100e0)).alias("prob"))
    found = best.groupBy("study_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("label", "prob"))), lambda x: F.struct(F.concat(F.lit("cnn:"), x["label"]).alias("evidence_id"), x["label"].alias("label"), x["prob"].alias("prob"))).alias("found"))
    draft = found.select("study_id", models.offline_report(F.col("found")).alias("s"))
    line = lambda x: F.concat_ws("|", x["section"], x["text"], F.array_join(x["evidence_ids"], ","))
    return draft.select("study_id", F.sha2(F.array_join(F.transform("s", line), "\n"), 256).alias("report"), F.exists("s", lambda x: (x["section"] == "impression") & x["text"].contains(models.IMPRESSION[2])).alias("positive"))


@query("""WITH b AS (SELECT l_orderkey, CAST(l_linenumber % 4 <> 0 AND (l_quantity > 45 OR p_partkey IS NULL) AS INTEGER) AS bad FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON l_partkey = p_partkey)
  SELECT l_orderkey, sum(bad) AS removed, max(bad) = 1 AS retried, count(*) - sum(bad) AS left FROM b GROUP BY 1""")
def evidence_retry_and_strip(spark, d):
    """An order is a draft, its lines are sentences that cite a part, or nothing where the quantity is large; parts of a small size are known."""
    rows = _t(spark, d, "lineitem").join(_t(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("known")), F.col("l_partkey") == F.col("known"), "left")
    section = F.get(F.array(*map(F.lit, vocab.SECTIONS)), (F.col("l_linenumber") % 4).cast("int"))
    cited = F.when(F.col("l_quantity") <= 45, F.array(F.col("l_partkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    sentence = F.struct(F.col("l_linenumber").cast("string").alias("text"), section.alias("section"), cited.alias("evidence_ids"))
    drafts = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(sentence)).alias("draft"), F.collect_set(F.col("known").cast("string")).alias("known"))
    return studies.evidence_check(drafts).select("l_orderkey", F.col("removed").cast("long").alias("removed"), "retried", F.size("draft").cast("long").alias("left"))


@query("""WITH c AS (SELECT contains(lower(text), 'the') AS must_block, contains(text, 'the') AS blocked, turn > 0 AS disclaimed FROM conversations), a AS (SELECT count(*) AS n_cases, avg(CAST(blocked AS INTEGER)) FILTER (WHERE must_block) AS block_rate,
  avg(CAST(blocked AS INTEGER)) FILTER (WHERE NOT must_block) AS false_positive_rate, avg(CAST(disclaimed AS INTEGER)) AS disclaimer_rate FROM c)
  SELECT 'language' AS suite, n_cases, round(block_rate, 6) AS block_rate, round(false_positive_rate, 6) AS false_positive_rate, round(disclaimer_rate, 6) AS disclaimer_rate, block_rate = 1 AND disclaimer_rate = 1 AS passed FROM a""")
def language_suite(spark, d):
    has = F.contains("text", F.lit("the"))
    cases = _t(spark, d, "conversations").select(F.contains(F.lower("text"), F.lit("the")).alias("must_block"), has.alias("blocked"), (F.col("turn") > 0).alias("disclaimed"))
    return gates.language_suite(cases).select("suite", "n_cases", *(_r(F.col("metrics")[k]).alias(k) for k in ("block_rate", "false_positive_rate", "disclaimer_rate")), "passed")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, max(CASE WHEN p_partkey IS NULL THEN 0 ELSE 1 END) AS ok FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 40) ON l_partkey = p_partkey GROUP BY 1, 2),
  s AS (SELECT l_orderkey, count(*) AS claims, sum(ok) AS supported FROM t GROUP BY 1)
  SELECT 'evidence' AS suite, count(*) AS n_cases, round(sum(supported) * 1e0 / sum(claims), 6) AS coverage, bool_and(claims = supported) AS passed FROM s""")
def evidence_suite(spark, d):
    rows = evidence.coverage(_cited(spark, d), _known(spark, d), "l_orderkey", ["l_linenumber"])
    return gates.evidence_suite(rows, 0).select("suite", "n_cases", _r(F.col("metrics")["coverage"]).alias("coverage"), "passed")


@query("""WITH c AS (SELECT event_type = 'error' AS injection, value > 20 AS ok FROM events), a AS (SELECT count(*) AS n_cases, avg(CAST(ok AS INTEGER)) FILTER (WHERE injection) AS block_rate, avg(CAST(ok AS INTEGER)) FILTER (WHERE NOT injection) AS invariance FROM c)
  SELECT 'robustness' AS suite, n_cases, round(block_rate, 6) AS block_rate, round(invariance, 6) AS invariance, block_rate = 1 AND invariance = 1 AS passed FROM a""")
def robustness_suite(spark, d):
    attack, ok = F.col("event_type") == "error", F.col("value") > 20
    cases = _t(spark, d, "events").select(F.when(attack, ok).alias("blocked"), F.when(~attack, ok).alias("invariant"))
    return gates.robustness_suite(cases).select("suite", "n_cases", *(_r(F.col("metrics")[k]).alias(k) for k in ("block_rate", "invariance")), "passed")


@query("""WITH h AS (SELECT conv_id, count(DISTINCT role) FILTER (WHERE role IN ('user', 'assistant', 'system')) AS n FROM conversations GROUP BY 1) SELECT 'golden' AS suite, count(*) AS n_cases, round(avg(n / 3e0), 6) AS sections, round(avg(CASE WHEN n = 3 THEN 1e0 ELSE 0e0 END), 6) AS pass_rate FROM h""")
def golden_suite(spark, d):
    roles = ("user", "assistant", "system")
    missing = evidence.missing_sections(_t(spark, d, "conversations"), roles, "conv_id", "role")
    drafts = missing.select((1 - F.size("missing") / F.lit(len(roles))).alias("completeness"), (F.size("missing") == 0).alias("complete"))
    return gates.golden_suite(drafts).select("suite", "n_cases", *(_r(F.col("metrics")[k]).alias(k) for k in ("sections", "pass_rate")))


@query("""WITH c AS (SELECT lang, toxic = 1 AS x, n_chars > 1500 AS hit FROM labels JOIN documents USING (doc_id)) SELECT 'critical' AS suite, count(*) AS n_cases, round(avg(CAST(hit AS INTEGER)) FILTER (WHERE x), 6) AS recall, round(avg(CAST(hit AS INTEGER)) FILTER (WHERE NOT x), 6) AS false_positive_rate,
  coalesce(avg(CAST(hit AS INTEGER)) FILTER (WHERE x) = 1, false) AS passed FROM c""")
def critical_suite(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("study_id"), F.col("lang").alias("label"), "n_chars")
    cases = _t(spark, d, "labels").select(F.col("doc_id").alias("study_id"), (F.col("toxic") == 1).alias("expected")).join(docs, "study_id")
    return gates.critical_suite(cases, docs.where("n_chars > 1500")).select("suite", "n_cases", *(_r(F.col("metrics")[k]).alias(k) for k in ("recall", "false_positive_rate")), "passed")


@query("SELECT kind, count(*) AS n, count(DISTINCT sample) AS samples FROM (SELECT event_type AS kind, user_id AS sample FROM events WHERE value > 50) GROUP BY GROUPING SETS ((kind), ())")
def leaks_by_kind(spark, d):
    return gates.leaks_by_kind(_t(spark, d, "events").where("value > 50").select(F.col("event_type").alias("kind"), F.col("user_id").alias("sample")))


_WIDE = [c for c in zip(text.FULL, text.HALF) if c[1] != " "]


@query("SELECT doc_id, sha256(text) AS folded FROM documents")
def width_folding(spark, d):
    wide = F.translate("text", "".join(h for _, h in _WIDE), "".join(f for f, _ in _WIDE))
    return _t(spark, d, "documents").select("doc_id", F.sha2(text.fold_width(F.concat(wide, F.lit("\u200b"))), 256).alias("folded"))


@query(r"""SELECT conv_id, turn, sha256(trim(regexp_replace(coalesce(text, '') || ' x', '\s+', ' ', 'g'))) AS clean FROM conversations""")
def sanitized_text(spark, d):
    dirty = F.concat(F.coalesce("text", F.lit("")), F.lit(" \u200bx\u00ad \n"))
    return _t(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.sanitize(dirty, nfkc=False), 256).alias("clean"))


@query(f"""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations)
  SELECT conv_id, turn, sha256('<UNTRUSTED>' || translate({_chain("s", [(p, "[removed]") for p, _ in rules.ATTACKS] + [(rules.VERDICT_FORCING.replace("'", "''"), "[removed]")])}, '<>', '‹›') || '</UNTRUSTED>') AS wrapped FROM t WHERE s IS NOT NULL""")
def untrusted_text(spark, d):
    return _t(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.sha2(text.untrusted(F.col("text")), 256).alias("wrapped"))


@query("""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'made by ai' WHEN 1 THEN '机器 made, 医师 signs' WHEN 2 THEN 'ＡＩ，须复核' ELSE '复核' END AS t FROM documents) SELECT doc_id, doc_id % 4 IN (1, 2) AS ok FROM t""")
def disclaimer_facts(spark, d):
    said = F.get(F.array(*map(F.lit, ("made by ai", "机器 made, 医师 signs", "ＡＩ，须复核", "复核"))), (F.col("doc_id") % 4).cast("int"))
    return _t(spark, d, "documents").select("doc_id", text.has_disclaimer(said).alias("ok"))


_RAW = (("small left pleural effusion", "PleuralEffusion"), ("mild cardiomegaly", "Cardiomegaly"), ("left hilar mass lesion", None), ("tiny right-sided pneumothorax.", "Pneumothorax"), ("no mass", None))


@query(f"""SELECT event_id, v.label, v.negated FROM events JOIN (VALUES {", ".join(f"({k}, {'NULL' if x is None else repr(x)}, {str(t.startswith('no ')).lower()})" for k, (t, x) in enumerate(_RAW))}) v(k, label, negated) ON event_id % {len(_RAW)} = k""")
def relaxed_labels(spark, d):
    raw = F.get(F.array(*(F.lit(t) for t, _ in _RAW)), (F.col("event_id") % len(_RAW)).cast("int"))
    return _t(spark, d, "events").select("event_id", text.canonical_relaxed(raw, ascii_only=True).alias("label"), text.is_negated(raw).alias("negated"))


@query(r"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n FROM documents""")
def sentence_split(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n"))


@query(f"""WITH s AS (SELECT p_partkey, lower(p_name || CASE p_partkey % 3 WHEN 0 THEN ' Large one' WHEN 1 THEN ' traces, tiny' ELSE '' END) AS s FROM part)
  SELECT p_partkey, CASE WHEN regexp_matches(s, '\\b({"|".join(vocab.LARGE_WORDS)})\\b') THEN 'large' WHEN regexp_matches(s, '\\b({"|".join(vocab.SMALL_WORDS)})\\b') THEN 'small' ELSE 'unspecified' END AS severity FROM s""")
def effusion_severity(spark, d):
    tail = F.get(F.array(F.lit(" Large one"), F.lit(" traces, tiny"), F.lit("")), (F.col("p_partkey") % 3).cast("int"))
    return _t(spark, d, "part").select("p_partkey", text.effusion_severity(F.concat("p_name", tail)).alias("severity"))


_SAID = ("No pneumothorax. Large pleural effusion.", "Cannot exclude effusion!", "Heart is normal.")
_MENTIONS = ((0, "pneumothorax", "negated", None), (0, "pleural effusion", "affirmed", "large"), (0, "effusion", "affirmed", "large"), (1, "effusion", "hedge", "unspecified"))


@query(f"""SELECT event_id, v.keyword, v.classification, v.severity FROM events JOIN (VALUES {", ".join(f"({k}, '{w}', '{c}', {'NULL' if x is None else repr(x)})" for k, w, c, x in _MENTIONS)}) v(k, keyword, classification, severity) ON event_id % 3 = k""")
def report_mentions(spark, d):
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 3).cast("int"))
    return _t(spark, d, "events").select("event_id", F.inline(text.mentions(said))).select("event_id", "keyword", "classification", "severity")


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['Cardiomegaly', 'PleuralEffusion'] WHEN 1 THEN [] ELSE ['Fracture'] END AS labels, p_partkey % 3 = 1 AS normal FROM part""")
def weak_labels(spark, d):
    some = lambda *x: F.array(*map(F.lit, x))
    mesh = F.when(F.col("p_partkey") % 3 == 0, some("Cardiomegaly/mild", "Pleural Effusion/left", "Cardiomegaly")).when(F.col("p_partkey") % 3 == 1, some("normal", " Normal ")).otherwise(some("Fractures, Bone/ribs", "Spine/degenerative"))
    return _t(spark, d, "part").select("p_partkey", text.weak_labels(mesh).alias("labels"), calibrate.is_normal(mesh).alias("normal"))


_DRAFTS = ('{"impression": [{"text": "b", "evidence_ids": ["x"]}], "findings": [{"text": "a", "evidence_ids": []}, {"text": " "}]}', '{"sentences": [{"text": "b", "section": "impression", "evidence_ids": []}, {"text": "a", "section": "technique"}]}', '[{"text": "c", "section": "findings", "evidence_ids": ["y"]}]', "no report")
_WROTE = ((0, 0, "findings", "a"), (0, 1, "impression", "b"), (1, 0, "technique", "a"), (1, 1, "impression", "b"), (2, 0, "findings", "c"))


@query(f"""SELECT event_id, v.pos, v.section, v.text FROM events JOIN (VALUES {", ".join(f"({k}, {n}, '{x}', '{t}')" for k, n, x, t in _WROTE)}) v(k, pos, section, text) ON event_id % 4 = k""")
def drafts_of_replies(spark, d):
    reply = F.get(F.array(*map(F.lit, _DRAFTS)), (F.col("event_id") % 4).cast("int"))
    rows = _t(spark, d, "events").select("event_id", F.posexplode(replies.draft_sentences(reply)).alias("pos", "s"))
    return rows.select("event_id", "pos", "s.section", "s.text")


@query(f"""WITH t AS (SELECT conv_id, turn, turn % 3 = 0 AS blocked, trim(regexp_replace(coalesce(text, '') || ' x', '\\s+', ' ', 'g')) AS s FROM conversations),
  c AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(s, '{p}', 'i') THEN '{c}'" for p, c in _RE2)} ELSE '' END AS category FROM t) SELECT conv_id, turn, blocked, CASE WHEN category = '' THEN [] ELSE ['possible injection: ' || category] END AS notes FROM c""")
def study_intake(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 0, "f.png").otherwise(" ").alias("image_path"), F.col("text").alias("indication"), F.lit("x").alias("history"))
    return studies.intake(rows).select("conv_id", "turn", "blocked", "notes")


@query(_scrub_sql("documents", "doc_id"))
def scrubbed_digests(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.col("text").alias("indication"), F.lit("").alias("history"))
    return studies.scrubbed(rows).select("doc_id", F.col("indication_fired").alias("fired"), F.col("indication_sha").alias("before"), F.sha2("indication", 256).alias("after"))


_COMMITS = ("Diagnosed: mass.", "We rule out a mass", "Treat  with oxygen,", "prescribed for", "明确诊断为肺炎。建议尽快手术。", "no mass,", "Mass IS RULED OUT and", "excludes the possibility")


def _neutral_sql(t: str) -> str:
    for p, to in rules.NEUTRAL:
        t = f"regexp_replace({t}, '{p}', '{to}', 'g')"
    return t


@query(f"""WITH c AS (SELECT conv_id, turn, ({[*_COMMITS]})[1 + (conv_id + turn) % {len(_COMMITS)}] || ' ' || coalesce(text, '') AS t, CASE WHEN turn % 3 = 0 THEN 'AI 生成，医师复核' ELSE 'none' END AS disclaimer FROM conversations)
  SELECT conv_id, turn, sha256(CASE WHEN {" OR ".join(f"regexp_matches(t, '(?i){p}')" for _, p in rules.REDLINES if "(?!" not in p)} THEN {_neutral_sql('t')} ELSE t END) AS said, CASE WHEN turn % 3 = 0 THEN disclaimer ELSE '{models.DISCLAIMER}' END AS disclaimer FROM c""")
def language_guard(spark, d):
    """Each turn's text behind words that commit, or don't. (The rule with a lookahead is left out of the SQL: its words are met by another.)"""
    said = F.concat_ws(" ", F.get(F.array(*map(F.lit, _COMMITS)), ((F.col("conv_id") + F.col("turn")) % len(_COMMITS)).cast("int")), F.coalesce("text", F.lit("")))
    s = F.struct(said.alias("text"), F.lit("findings").alias("section"), F.array(F.lit("e")).alias("evidence_ids"))
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.array(s).alias("draft"), F.when(F.col("turn") % 3 == 0, "AI 生成，医师复核").otherwise("none").alias("disclaimer"))
    return studies.language_guard(rows).select("conv_id", "turn", F.sha2(F.col("draft")[0]["text"], 256).alias("said"), "disclaimer")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'GUARDRAIL_BLOCKED' WHEN p_partkey % 7 = 0 THEN 'NEEDS_REPEAT' WHEN p_partkey % 5 = 0 THEN 'CRITICAL_ESCALATED' WHEN p_partkey % 3 = 0 THEN 'HELD' WHEN p_partkey % 2 = 0 THEN 'DRAFT_READY' ELSE 'HELD' END AS status FROM part""")
def study_status(spark, d):
    k = F.col("p_partkey")
    s = lambda t, x: F.struct(t.alias("text"), F.lit(x).alias("section"), F.array(F.lit("e")).alias("evidence_ids"))
    draft = F.array(*(s(F.when(k % 2 == 0, "clear").otherwise("treat with x"), x) for x in vocab.SECTIONS))
    rows = _t(spark, d, "part").select("p_partkey", draft.alias("draft"), F.lit(models.DISCLAIMER).alias("disclaimer"), (k % 11 == 0).alias("blocked"), (k % 7 != 0).alias("qc_ok"), F.when(k % 5 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("alerts"), (k % 3 == 0).alias("held"))
    return studies.status(rows).select("p_partkey", "status")


@query("""SELECT study_id, path FROM (SELECT study_id, path, row_number() OVER (PARTITION BY study_id ORDER BY view <> 'frontal', round(symmetry, 6) DESC, path) AS rank
  FROM (SELECT CAST(l_orderkey AS VARCHAR) AS study_id, l_linenumber || '-' || l_partkey AS path, CASE WHEN l_returnflag = 'R' THEN 'lateral' ELSE 'frontal' END AS view, l_discount AS symmetry FROM lineitem)) WHERE rank = 1""")
def primary_film(spark, d):
    l = _t(spark, d, "lineitem")
    views = l.select(F.col("l_orderkey").cast("string").alias("study_id"), F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("path"), F.when(F.col("l_returnflag") == "R", "lateral").otherwise("frontal").alias("view"), F.col("l_discount").alias("symmetry"))
    return studies.ranked_primary(views).select("study_id", "path")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark, d):
    return feed.counts(_t(spark, d, "events"))


@query("""SELECT event_id, 'event: node' || chr(10) || 'data: {"event_id":' || event_id || ',"node":"' || event_type || '"}' || chr(10) || chr(10) AS frame FROM events""")
def event_frames(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("event_type").alias("node"))
    framed = feed.frames("node", e)
    return framed.select(F.regexp_extract("frame", '"event_id":([0-9]+)', 1).cast("long").alias("event_id"), "frame")


@query("""SELECT page_id, sha256('data:text/html;base64,' || to_base64(encode(html))) AS uri, sha256('x [MASKED text/html · sha256:' || substr(sha256(to_base64(encode(html))), 1, 12) || ' · ' || strlen(to_base64(encode(html))) || ' b64 chars] y') AS masked FROM pages WHERE html IS NOT NULL AND html <> ''""")
def image_uris(spark, d):
    uri = corpus.data_uri(F.lit("text/html"), F.encode("html", "UTF-8"))
    flat = F.regexp_replace(uri, "[\r\n]", "")
    return _t(spark, d, "pages").where("html is not null and html <> ''").select("page_id", F.sha2(flat, 256).alias("uri"), F.sha2(text.mask_data_uris(F.concat(F.lit("x "), flat, F.lit(" y"))), 256).alias("masked"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice >= l_quantity * 10 * 20 * 2 AS complete, l_linenumber % 3 <> 0 AS dicom FROM lineitem""")
def film_completeness(spark, d):
    path = F.get(F.array(F.lit("a.png"), F.lit("b.DCM"), F.lit("c.dicom")), F.col("l_linenumber") % 3)
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", corpus.pixels_complete(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(10), F.lit(20), F.lit(16)).alias("complete"), corpus.is_dicom(path).alias("dicom"))


@query(f"""WITH {_MATCH}, v AS (SELECT *, CASE WHEN kind = 'unique' THEN 'UNCERTAIN' WHEN kind = 'magnitude' THEN 'CONFIRM' WHEN coalesce(greatest(a_prob, b_prob), 0) >= 0.6 THEN 'CONFIRM' ELSE 'REJECT' END AS verdict FROM g),
  d AS (SELECT study_id, string_agg(label || ':' || coalesce(CAST(CAST(round(a_prob * 1000000) AS BIGINT) AS VARCHAR), '-') || ':' || coalesce(CAST(CAST(round(b_prob * 1000000) AS BIGINT) AS VARCHAR), '-') || ':' || CASE WHEN kind = 'agree' THEN 'agreed' ELSE kind || '/' || verdict END, ',' ORDER BY label) AS dual FROM v GROUP BY 1),
  t AS (SELECT study_id, CASE WHEN count(*) >= 2 THEN (max(ord) - min(ord)) * 1000e0 END AS latency_ms, arg_min(label, ord) AS first_node, count(*) FILTER (WHERE reader = 'a') AS n_a, count(DISTINCT label) AS evidence, count(DISTINCT label) FILTER (WHERE label IN ('error', 'purchase') AND prob >= 0.3) AS n_alerts FROM r GROUP BY 1)
  SELECT study_id, CASE WHEN n_alerts > 0 THEN 'CRITICAL_ESCALATED' ELSE 'DRAFT_READY' END AS status, n_alerts > 0 AS blocked, dual, least(n_a, 1) AS loci, greatest(n_a - 1, 0) AS elsewhere, evidence, n_alerts, latency_ms, first_node FROM d JOIN t USING (study_id)""")
def study_dashboard(spark, d):
    """A study's display film is the first that the first reader saw; every reading of theirs has a locus."""
    rows = readings(spark, d).withColumns({"locus": F.struct(F.lit(0.5).alias("cx"), F.lit(0.5).alias("cy"), F.lit(0.1).alias("r")), "mapped": F.lit(True), "source": F.lit("cnn")})
    m = _merged(spark, d).where("kind <> 'agree'").withColumn("verdict", findings.offline_verdict(F.col("kind"), F.col("a_prob"), F.col("b_prob")))
    argued = m.groupBy("study_id").agg(F.collect_list(F.struct(F.lit(1).alias("position"), "label", "kind", "verdict", "in_vocabulary", "a_prob", "b_prob")).alias("disagreements"))
    alerts = findings.triage(rows, 0.3, CRITICAL).groupBy("study_id").agg(F.collect_list(F.struct("label", "prob")).alias("alerts"))
    seen = rows.groupBy("study_id").agg(F.collect_list(F.struct(F.concat_ws(":", "source", "label").alias("evidence_id"), "label", "prob")).alias("findings"), F.min(F.when(F.col("reader") == "a", F.col("ord"))).cast("string").alias("image_path"))
    states = seen.join(argued, "study_id", "left").join(alerts, "study_id", "left").withColumns({"status": F.when(F.col("alerts").isNotNull(), "CRITICAL_ESCALATED").otherwise("DRAFT_READY"), "kappa": F.lit(1.0), "draft": F.array(), "disclaimer": F.lit(""), "removed": F.lit(0), "budget_spent": F.lit(0)})
    trace = rows.select("study_id", F.col("label").alias("node"), F.col("ord").cast("double").alias("ts"))
    out = dashboard.dashboard(states, trace, rows).select("study_id", "dashboard.*")
    prob = lambda p: F.coalesce(F.round(p * 1_000_000).cast("long").cast("string"), F.lit("-"))
    line = lambda x: F.concat_ws(":", x["label"], prob(x["a_prob"]), prob(x["b_prob"]), F.when(x["agreed"], "agreed").otherwise(F.concat_ws("/", x["kind"], x["verdict"])))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select("study_id", "status", "blocked", F.array_join(F.transform("dual_read.rows", line), ",").alias("dual"), F.size("image.loci").cast("long").alias("loci"), F.col("image.loci_on_other_views").cast("long").alias("elsewhere"),
        F.size("report.evidence_map").cast("long").alias("evidence"), F.when(F.col("critical.alerts").isNull(), F.lit(0)).otherwise(size("critical.alerts")).cast("long").alias("n_alerts"), F.col("audit.latency_ms").alias("latency_ms"), F.get("critical.timeline", F.lit(0))["node"].alias("first_node"))
