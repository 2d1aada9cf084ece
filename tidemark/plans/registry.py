"""The queries of the engine's own operators, each over whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.api import Scanner
from tidemark.functions import generalize as G
from tidemark.functions.local import small
from tidemark.functions.validators import VALIDATORS
from tidemark.operators import context, detect, evaluate, intervals, medical, optimize, policy, severity, synthetic, tables, utility
from tidemark.operators.store import saved, shared_dir
from tidemark.streaming import stream

from . import sql as Q
from .rules import Rule, catalogue, only

QUERIES, ORACLES = {}, {}
FOUR = Q.FOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Small files come as one partition; a scan of texts wants all cores.  Large inputs are split already and stay."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def texts(spark, sf_dir: str) -> DataFrame:
    return detect.documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def spans(spark, sf_dir: str, *names: str) -> DataFrame:
    return detect.scan(texts(spark, sf_dir), only(*names or FOUR))


def doc_id() -> Column:
    return F.col("source_id").cast("long").alias("doc_id")


def _l(*cols: str) -> list[Column]:
    return [F.col(c).cast("long").alias(c) for c in cols]


def _scan(name: str):
    def run(spark, sf_dir):
        return spans(spark, sf_dir, name).select(doc_id(), *_l("start", "end"), "text")

    run.__name__ = f"scan_{name}"
    query(f'SELECT doc_id, start, "end", text FROM {Q.found((name,))}')(run)


for _name in FOUR:
    _scan(_name)


@query(f'SELECT DISTINCT doc_id, start, "end", entity_id FROM {Q.every_span()}')
def scan_catalogue(spark, sf_dir):
    """Every pattern of every rule over all documents; the SQL's patterns are written apart from the rules'."""
    return detect.scan(texts(spark, sf_dir), catalogue()).select(doc_id(), *_l("start", "end"), "entity_id").distinct()


@query(r"""SELECT k AS source, start, "end", m AS text FROM (SELECT k, CAST(before + upto AS BIGINT) AS start, CAST(before + upto + length(m) AS BIGINT) AS "end", m FROM (
 SELECT k, m, sum(length(pre)) OVER (PARTITION BY k ORDER BY i) AS before, coalesce(sum(length(m)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
 FROM (SELECT k, unnest(ms) AS m, unnest(s[1:len(ms)]) AS pre, unnest(range(len(ms))) AS i FROM (SELECT conv_id || ':' || turn AS k, regexp_extract_all(text, '[A-Z][a-z]{3,11}[.?!]') AS ms, regexp_split_to_array(text, '[A-Z][a-z]{3,11}[.?!]') AS s FROM conversations))))""")
def scan_conversations(spark, sf_dir):
    """A rule of the user's own over all turns; the catalogue's find nothing in these."""
    c = spread(table(spark, sf_dir, "conversations")).select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    own = (Rule("own::closing_word", "neutral", patterns=("[A-Z][a-z]{3,11}[.?!]",)),)
    return detect.scan(detect.documents(c, "text", "k"), own).select(F.col("source_id").alias("source"), *_l("start", "end"), "text")


@query(f"""SELECT page_id, start, "end", text FROM {Q.spans("ip_address", "pages", "page_id", "html")}""")
def scan_pages(spark, sf_dir):
    p = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    return detect.scan(detect.documents(p, "html", "page_id"), only("ip_address")).select(F.col("source_id").cast("long").alias("page_id"), *_l("start", "end"), "text")


@query(f'SELECT doc_id, start, "end", entity, valid, round(confidence, 6) AS confidence FROM {Q.found()}')
def detection_confidence(spark, sf_dir):
    return spans(spark, sf_dir).select(doc_id(), *_l("start", "end"), "entity", "valid", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH f AS (SELECT doc_id, start, "end", 'pii::phone_number' AS entity_id FROM {Q.found(("phone_number",))} UNION ALL SELECT doc_id, start, "end", 'pii::fax_number' FROM {Q.spans("fax_number")})
SELECT doc_id, start, "end", max(entity_id) AS entity_id FROM f GROUP BY ALL""")
def dedupe_spans(spark, sf_dir):
    return detect.dedupe(spans(spark, sf_dir, "phone_number", "fax_number")).select(doc_id(), *_l("start", "end"), "entity_id")


@query(f"SELECT entity, count(*) AS n, count(*) FILTER (valid) AS n_valid, round(avg(confidence), 6) AS confidence, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM {Q.found()} GROUP BY entity")
def entity_rollup(spark, sf_dir):
    return spans(spark, sf_dir).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.round(F.avg("confidence"), 6).alias("confidence"), F.count_distinct("source_id").alias("documents"))


@query(r"""WITH RECURSIVE b AS (SELECT list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: true) AS w FROM benchmark WHERE text IS NOT NULL),
g AS (SELECT DISTINCT list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS surface, n FROM (SELECT w, n, unnest(range(1, greatest(len(w) - n, 0) + 2)) AS i FROM b, (VALUES (2), (3)) AS t(n)) WHERE i <= len(w)),
terms AS (SELECT DISTINCT surface, len(string_split(surface, ' ')) AS n FROM g WHERE length(surface) >= 4 AND surface NOT IN ('disease', 'syndrome', 'disorder', 'pain', 'other', 'normal', 'water', 'air', 'food', 'test', 'patient')),
d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS ms, regexp_split_to_array(lower(text), '[a-z0-9]+') AS s FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, m, i, sum(length(pre)) OVER (PARTITION BY doc_id ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (SELECT doc_id, unnest(ms) AS m, unnest(s[1:len(ms)]) AS pre, unnest(range(len(ms))) AS i FROM d)),
n1 AS (SELECT doc_id, i, a, m, lead(m) OVER x AS m2, lead(m, 2) OVER x AS m3, lead(a) OVER x AS a2, lead(a, 2) OVER x AS a3 FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i)),
h0 AS (SELECT doc_id, a, a + length(m) AS b, m AS surface FROM n1 UNION ALL SELECT doc_id, a, a2 + length(m2), m || ' ' || m2 FROM n1 WHERE m2 IS NOT NULL UNION ALL SELECT doc_id, a, a3 + length(m3), m || ' ' || m2 || ' ' || m3 FROM n1 WHERE m3 IS NOT NULL),
h AS (SELECT doc_id, a, b, surface, row_number() OVER (PARTITION BY doc_id ORDER BY a, b DESC) AS k FROM h0 SEMI JOIN terms USING (surface)),
r AS (SELECT doc_id, k, a, b, surface, true AS kept, b AS upto FROM h WHERE k = 1 UNION ALL SELECT h.doc_id, h.k, h.a, h.b, h.surface, h.a >= r.upto, CASE WHEN h.a >= r.upto THEN h.b ELSE r.upto END FROM r JOIN h ON h.doc_id = r.doc_id AND h.k = r.k + 1)
SELECT r.doc_id, CAST(a AS BIGINT) AS start, CAST(b AS BIGINT) AS "end", substr(d.text, CAST(a + 1 AS INT), CAST(b - a AS INT)) AS text, surface AS canonical FROM r JOIN d ON d.doc_id = r.doc_id WHERE kept""")
def dictionary_scan(spark, sf_dir):
    """All phrases of two and three words of the test items, as a dictionary."""
    b = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    grams = b.select(F.explode(F.flatten(F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.array_join(F.slice("w", i + 1, n), " "))))).alias("term"))
    terms = medical.merge([grams.select("term", F.lit("phi::medical_condition").alias("entity_id"), F.col("term").alias("canonical"), F.sha2("term", 256).alias("code"), F.lit("items").alias("source"))])
    d = detect.dictionary(texts(spark, sf_dir), terms, 3)
    return d.select(doc_id(), *_l("start", "end"), "text", "canonical")


_SPOKEN = ("credit_card_number", "phone_number", "bank_account_number", "cvv_code")


def _context_sql() -> str:
    phrases = ", ".join(f"('{r.name}', '{p}', {r.phrase_weight or 0.4}, {r.before}, {r.after})" for r in only(*_SPOKEN) for p in r.phrases)
    left, right = Q.ascii_only("lower(substr(d.text, CAST(greatest(s.start - 79, 1) AS INT), CAST(least(s.start, 80) AS INT)))", "_"), Q.ascii_only('lower(substr(d.text, CAST(s."end" + 1 AS INT), 80))', "_")
    return rf"""WITH p(entity, phrase, weight, wb, wa) AS (VALUES {phrases}), s AS (SELECT * FROM {Q.found(_SPOKEN)}),
    w AS (SELECT s.doc_id, s.start, s."end", s.entity, p.phrase, p.weight, right({left}, p.wb) AS l, left({right}, p.wa) AS r FROM s JOIN documents d ON d.doc_id = s.doc_id JOIN p ON p.entity = s.entity),
    near AS (SELECT *, CASE WHEN contains(phrase, ' ') THEN CASE WHEN contains(l, phrase) THEN length(l) - strpos(reverse(l), reverse(phrase)) + 1 END WHEN regexp_matches(l, '' || phrase || '') THEN length(regexp_extract(l, '(?s)^.*' || phrase || '', 0)) END AS b,
      CASE WHEN contains(phrase, ' ') THEN CASE WHEN contains(r, phrase) THEN strpos(r, phrase) - 1 END WHEN regexp_matches(r, '' || phrase || '') THEN length(regexp_extract(r, '(?s)^(.*?)' || phrase || '', 1)) END AS a FROM w),
    x AS (SELECT doc_id, start, "end", entity, weight * greatest(coalesce((1 - least(1.0, (length(l) - b) / greatest(1, length(l)))) * 1.25, -1), coalesce(1 - least(1.0, a / greatest(1, length(r))), -1)) AS part FROM near WHERE a IS NOT NULL OR b IS NOT NULL),
    c AS (SELECT doc_id, start, "end", entity, greatest(0.0, least(1.0, sum(part) + 0.05 * (count(*) - 1))) AS context FROM x GROUP BY ALL)
    SELECT s.doc_id, s.start, s."end", CASE s.entity WHEN 'phone_number' THEN 'pii::' ELSE 'fin::' END || s.entity AS entity_id, round(s.confidence, 6) AS confidence, round(coalesce(c.context, 0), 6) AS context, round(s.confidence + 0.35 * coalesce(c.context, 0) * (1 - s.confidence), 6) AS fused
    FROM s LEFT JOIN c ON c.doc_id = s.doc_id AND c.start = s.start AND c."end" = s."end" AND c.entity = s.entity"""


@query(_context_sql())
def context_scores(spark, sf_dir):
    s = spans(spark, sf_dir, *_SPOKEN)
    return context.rescored(s, only(*_SPOKEN)).select(doc_id(), *_l("start", "end"), "entity_id", F.round("confidence", 6).alias("confidence"), F.round("context", 6).alias("context"), F.round("fused", 6).alias("fused"))


@query()
def findings(spark, sf_dir):
    """The whole catalogue over all documents: detection, context, fusion, election, growth."""
    f = Scanner(spark).texts(texts(spark, sf_dir))
    return f.select(doc_id(), *_l("start", "end"), "text", "entity_id", F.round("confidence", 6).alias("confidence"), "winner_kind", "rescued")


def _elect_sql(rows: str) -> str:
    """o: spans in the order in which they are taken; last: the list of those taken, by document."""
    return f"""WITH RECURSIVE f AS {rows}, n AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM f b WHERE a.doc_id = b.doc_id AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start) AS free FROM f a),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY free DESC, CASE WHEN valid THEN 2 ELSE 1 END DESC, confidence DESC, "end" - start DESC, entity_id DESC, start DESC) AS k FROM n),
    r AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(a BIGINT, b BIGINT, e VARCHAR)[]) AS kept FROM o
      UNION ALL SELECT r.doc_id, r.k + 1, CASE WHEN len(list_filter(r.kept, lambda x: x.a < o."end" AND o.start < x.b)) > 0 THEN r.kept ELSE list_append(r.kept, {{'a': o.start, 'b': o."end", 'e': o.entity_id}}) END FROM r JOIN o ON o.doc_id = r.doc_id AND o.k = r.k + 1),
    last AS (SELECT doc_id, max_by(kept, k) AS kept FROM r GROUP BY doc_id)"""


_FIVE = f"""(SELECT *, CASE entity WHEN 'credit_card_number' THEN 'fin::' ELSE 'pii::' END || entity AS entity_id FROM {Q.found((*FOUR, "fax_number"))})"""
_ELECT = f"""WITH f AS (SELECT * FROM {Q.found()}), n AS (SELECT a.*, EXISTS (SELECT 1 FROM f b WHERE a.doc_id = b.doc_id AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start) AS nested FROM f a)"""


@query(f"""{_ELECT} SELECT doc_id, start, "end", entity, nested FROM n""")
def nested_spans(spark, sf_dir):
    s = spans(spark, sf_dir)
    wide = s.select(F.col("source_id").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    inside = s.join(wide, (F.col("source_id") == F.col("_s")) & (F.col("_a") <= F.col("start")) & (F.col("_b") >= F.col("end")) & (F.col("_b") - F.col("_a") > F.col("end") - F.col("start")), "left_semi").select("source_id", "start", "end", "entity").distinct().withColumn("nested", F.lit(True))
    return s.join(inside, ["source_id", "start", "end", "entity"], "left").select(doc_id(), *_l("start", "end"), "entity", F.coalesce("nested", F.lit(False)).alias("nested"))


@query(f"""{_elect_sql(f'(SELECT * FROM {_FIVE} QUALIFY row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY confidence DESC, entity_id DESC) = 1)')} SELECT doc_id, x.a AS start, x.b AS "end", x.e AS entity_id FROM (SELECT doc_id, unnest(kept) AS x FROM last)""")
def elected_spans(spark, sf_dir):
    s = spans(spark, sf_dir, *FOUR, "fax_number")
    return intervals.elected(detect.dedupe(s), only(*FOUR, "fax_number")).select(doc_id(), *_l("start", "end"), "entity_id")


@query(f"""{_elect_sql(_FIVE)} SELECT doc_id, start, "end", entity_id, w.e AS winner_id, CASE WHEN w.e = entity_id THEN 'absorbed' WHEN NOT free THEN 'nested' ELSE 'outranked' END AS reason
 FROM (SELECT o.*, list_filter(last.kept, lambda x: x.a < o."end" AND o.start < x.b)[1] AS w, list_contains(last.kept, {{'a': o.start, 'b': o."end", 'e': o.entity_id}}) AS won FROM o JOIN last ON last.doc_id = o.doc_id) WHERE NOT won""")
def lost_spans(spark, sf_dir):
    s = spans(spark, sf_dir, *FOUR, "fax_number")
    return intervals.losers(s, only(*FOUR, "fax_number")).select(doc_id(), *_l("start", "end"), "entity_id", "winner_id", "reason")


@query(f"SELECT doc_id, regexp_replace(text, '{Q.PATTERNS['pii::email_address'][0]}', '[EMAIL]', 'g') AS text FROM documents")
def mask_text(spark, sf_dir):
    t, rules = texts(spark, sf_dir), only("email_address")
    plan = policy.execute(policy.resolve(detect.scan(t, rules), rules))
    return policy.scrub(t, plan).select(doc_id(), "text")


@query(f"""SELECT doc_id, start, "end", {"CASE entity " + " ".join(f"WHEN '{k}' THEN '{v[3]}'" for k, v in Q.FOUND.items()) + " END"} || '_' || substr(sha256(text), 1, 8) AS hashed FROM {Q.found()}""")
def hash_values(spark, sf_dir):
    rules = only(*FOUR)
    plan = policy.execute(policy.resolve(spans(spark, sf_dir), rules, overrides={n: "hash" for n in FOUR}))
    return plan.select(doc_id(), *_l("start", "end"), F.col("new").alias("hashed"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS by_month, strftime(o_orderdate, '%Y') AS by_year, CAST(CAST(floor(year(o_orderdate) / 10) * 10 AS INT) AS VARCHAR) || 's' AS by_decade FROM orders")
def generalize_dates(spark, sf_dir):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[G.date(d, x).alias(f"by_{x}") for x in G.LADDERS["date"]])


@query("SELECT c_custkey, " + ", ".join(f"CASE WHEN a >= 90 THEN '90+' ELSE CAST(a - a % {w} AS VARCHAR) || '-' || CAST(a - a % {w} + {w} - 1 AS VARCHAR) END AS by_{w}" for w in (5, 10, 20)) + ", substr(z, 1, 3) || '**' AS zip_3, substr(z, 1, 1) || '****' AS zip_1, printf('%.1f', c_acctbal) AS place FROM (SELECT *, c_custkey % 100 AS a, lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') AS z FROM customer)")
def generalize_values(spark, sf_dir):
    a, z = (F.col("c_custkey") % 100).cast("string"), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")
    return table(spark, sf_dir, "customer").select("c_custkey", *[G.age(a, f"{w}y").alias(f"by_{w}") for w in (5, 10, 20)], G.zip_code(z, "3-digit").alias("zip_3"), G.zip_code(z, "1-digit").alias("zip_1"), G.coordinates(F.col("c_acctbal").cast("string"), "1dp").alias("place"))


#: by number of digits, what the customer's key is multiplied with to make a string of them
_KEYS = {9: 7919977, 10: 79199771, 12: 7919977123, 15: 791997712331, 16: 791997712331, 18: 791997712331}


def _digits(n: int) -> Column:
    return F.lpad(((F.col("c_custkey") * _KEYS[n]) % 10**n).cast("string"), n, "0")


_N9, _N10, _N12, _N15, _N16, _N18 = (f"lpad(CAST((c_custkey * {_KEYS[n]}) % {10**n} AS VARCHAR), {n}, '0')" for n in (9, 10, 12, 15, 16, 18))
_NHS = f"(11 - {Q.weighted(_N10, list(range(10, 1, -1)))} % 11)"
_IBAN_SQL = f"(CAST({_N18} || '131468' AS HUGEINT) % 97 = 1)"


@query(
    f"""SELECT c_custkey, {Q.luhn(_N16, 16)} AS luhn,
 (substr({_N9}, 1, 1) <> '9' AND substr({_N9}, 1, 3) NOT IN ('000', '666') AND substr({_N9}, 4, 2) <> '00' AND substr({_N9}, 6, 4) <> '0000') AS ssn,
 (substr({_N9}, 1, 1) = '9' AND substr({_N9}, 4, 1) IN ('7', '8')) AS itin,
 length(replace({_N9}, substr({_N9}, 1, 1), '')) > 0 AS sin,
 (substr({_N12}, 1, 1) NOT IN ('0', '1') AND length(replace({_N12}, substr({_N12}, 1, 1), '')) > 0) AS aadhaar,
 (CASE WHEN {_NHS} = 11 THEN 0 ELSE {_NHS} END = CAST(substr({_N10}, 10, 1) AS INT) AND {_NHS} <> 10) AS nhs,
 {Q.luhn(f"('80840' || {_N10})", 15)} AS npi, ({Q.weighted(_N9, [3, 7, 1] * 3)} % 10 = 0) AS aba, {Q.luhn(_N15, 15)} AS imei, {_IBAN_SQL} AS iban,
 {Q.phone_ok(_N10)} AS phone, (CAST(c_custkey % 400 AS INT) <= 255) AS ipv4, (c_acctbal BETWEEN -90 AND 90) AS latitude, (c_acctbal BETWEEN -180 AND 180) AS longitude, CAST({_N10} AS BIGINT) <= 978307200 AS unix_time FROM customer"""
)
def validators(spark, sf_dir):
    v, c = VALIDATORS, table(spark, sf_dir, "customer")
    balance = F.col("c_acctbal").cast("decimal(20,2)").cast("string")
    return c.select(
        "c_custkey", v["LUHN_CHECKSUM"](_digits(16)).alias("luhn"), v["US_SSN"](_digits(9)).alias("ssn"), v["US_ITIN"](_digits(9)).alias("itin"), v["CANADIAN_SIN"](_digits(9)).alias("sin"), v["INDIAN_AADHAAR"](_digits(12)).alias("aadhaar"), v["UK_NHS"](_digits(10)).alias("nhs"), v["NPI"](_digits(10)).alias("npi"),
        v["ABA_ROUTING_NUMBER"](_digits(9)).alias("aba"), v["IMEI"](_digits(15)).alias("imei"), v["IBAN"](F.concat(F.lit("DE68"), _digits(18))).alias("iban"), v["PHONE_US"](_digits(10)).alias("phone"), v["IPV4_RANGE"](F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 400).cast("string"))).alias("ipv4"), v["LATITUDE"](balance).alias("latitude"), v["LONGITUDE"](balance).alias("longitude"), v["UNIX_TIMESTAMP"](_digits(10)).alias("unix_time"),
    )


def assessed(spark, sf_dir: str) -> DataFrame:
    return severity.assess(saved(spans(spark, sf_dir)), only(*FOUR))  # what follows joins findings with themselves; the texts are scanned once


_A = f"(SELECT *, CASE entity WHEN 'credit_card_number' THEN 0.85 ELSE 0.9 END AS score0 FROM {Q.found()})"
_E = f"(SELECT f.*, s.strong, round(CASE WHEN s.strong >= 2 THEN score0 + (1 - score0) * least(0.45, 0.15 * (s.strong - 1)) ELSE score0 END, 6) AS score FROM {_A} f JOIN (SELECT doc_id, count(DISTINCT entity) AS strong FROM {_A} GROUP BY doc_id) s ON f.doc_id = s.doc_id)"
_LEVEL = "CASE WHEN score >= 0.93 THEN 'critical' WHEN score >= 0.65 THEN 'high' WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.2 THEN 'low' ELSE 'info' END"
_EL = f"(SELECT *, {_LEVEL} AS level FROM {_E})"
_ORDER = "list_position(['info', 'low', 'medium', 'high', 'critical'], level)"


@query(f"""SELECT doc_id, start, "end", entity, score, level, CAST(strong AS BIGINT) AS strong, CASE WHEN confidence < 0.6 THEN 'low_confidence' END AS review FROM {_EL}""")
def severity_levels(spark, sf_dir):
    return severity.escalate(assessed(spark, sf_dir)).select(doc_id(), *_l("start", "end"), "entity", "score", "level", "strong", "review")


@query(f"SELECT l.level, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT unnest(['info', 'low', 'medium', 'high', 'critical']) AS level) l LEFT JOIN (SELECT level, count(*) AS n FROM {_EL} GROUP BY level) x ON l.level = x.level")
def severity_histogram(spark, sf_dir):
    return severity.histogram(severity.escalate(assessed(spark, sf_dir)))


@query(f"SELECT entity, count(*) AS n, max_by(level, {_ORDER}) AS worst, round(avg(score), 6) AS mean_score, CASE entity WHEN 'credit_card_number' THEN 'CCPA,GDPR,PCI' ELSE 'CCPA,GDPR' END AS tags FROM {_EL} GROUP BY entity")
def per_entity(spark, sf_dir):
    return severity.per_entity(severity.escalate(assessed(spark, sf_dir)))


@query(f"SELECT doc_id, count(*) AS n, round(sum(score), 6) AS total_score, count(DISTINCT entity) AS strong, max_by(level, {_ORDER}) AS worst, list_aggregate(list_sort(list(DISTINCT entity)), 'string_agg', ',') AS entities FROM {_EL} GROUP BY doc_id")
def per_record(spark, sf_dir):
    return severity.per_record(severity.escalate(assessed(spark, sf_dir))).select(doc_id(), "n", "total_score", "strong", "worst", "entities")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS location, " + ", ".join(f"count(*) FILTER (level = '{x}') AS {x}" for x in severity.LEVELS) + f" FROM {_EL} GROUP BY doc_id")
def heatmap(spark, sf_dir):
    return severity.heatmap(severity.escalate(assessed(spark, sf_dir)))


@query(f"SELECT regulation, count(*) AS n, max_by(level, {_ORDER}) AS worst FROM (SELECT level, unnest(CASE entity WHEN 'credit_card_number' THEN ['PCI', 'GDPR', 'CCPA'] ELSE ['GDPR', 'CCPA'] END) AS regulation FROM {_EL}) GROUP BY regulation")
def compliance(spark, sf_dir):
    return severity.compliance(severity.escalate(assessed(spark, sf_dir)))


@query(f"""WITH d(position, category, entity) AS (VALUES {", ".join(f"({i}, '{c}', '{e}')" for i, (c, es) in enumerate(severity.SAFE_HARBOR.items(), 1) for e in es)}), f AS (SELECT entity, count(*) AS n FROM {Q.found()} GROUP BY entity)
SELECT position, category, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, coalesce(string_agg(d.entity, ',' ORDER BY d.entity) FILTER (n > 0), '') AS entities FROM d LEFT JOIN f ON d.entity = f.entity GROUP BY position, category""")
def checklist(spark, sf_dir):
    return severity.checklist(assessed(spark, sf_dir))


_MORE = (*FOUR, "zip_code")
_QUASI = _EL.replace(_A, f"(SELECT *, CASE entity WHEN 'credit_card_number' THEN 0.85 WHEN 'zip_code' THEN 0.55 ELSE 0.9 END AS score0 FROM {Q.found(_MORE)})").replace("count(DISTINCT entity) AS strong", "count(DISTINCT entity) FILTER (entity <> 'zip_code') AS strong")


@query(f"SELECT findings, severe, critical, round_even(CASE WHEN critical > 0 THEN greatest(raw, 40.0) ELSE raw END, 1) AS index FROM (SELECT count(*) AS findings, count(*) FILTER (level IN ('high', 'critical')) AS severe, count(*) FILTER (level = 'critical') AS critical, 100.0 * count(*) FILTER (level IN ('high', 'critical')) / count(*) AS raw FROM {_QUASI})")
def exposure_index(spark, sf_dir):
    found = severity.assess(saved(spans(spark, sf_dir, *_MORE)), only(*_MORE))
    return severity.exposure(severity.escalate(found)).select("findings", "severe", "critical", "index")


@query(f"""SELECT doc_id, start, "end", entity, score, 'low_confidence' AS review FROM {_EL} WHERE confidence < 0.6""")
def review_queue(spark, sf_dir):
    return severity.review_queue(severity.escalate(assessed(spark, sf_dir))).select(doc_id(), *_l("start", "end"), "entity", "score", "review")


def _people(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"), F.col("c_mktsegment").alias("segment"), (F.floor(F.col("c_acctbal") / 2000)).cast("string").alias("band"))


def _classes(spark, sf_dir: str) -> DataFrame:
    cells = tables.cells(_people(spark, sf_dir), "customer", "c_custkey")
    quasi = cells.withColumns({"entity": F.lit("city"), "data_class": F.lit("quasi_identifier"), "start": F.lit(0), "end": F.length("text")})
    return severity.k_classes(quasi)


_K = "(SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment, floor(c_acctbal / 2000)) AS k FROM customer)"


@query(f"SELECT c_custkey, k FROM {_K}")
def k_anonymity(spark, sf_dir):
    return _classes(spark, sf_dir).select(F.col("row").alias("c_custkey"), "k")


@query(f"SELECT count(*) AS records, min(k) AS k_min, count(*) FILTER (k = 1) AS singletons, count(*) FILTER (k < 5) AS below_threshold FROM {_K}")
def k_summary(spark, sf_dir):
    return severity.k_summary(_classes(spark, sf_dir))


@query("SELECT * FROM (UNPIVOT (SELECT c_custkey AS row, CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment, CAST(CAST(floor(c_acctbal / 2000) AS BIGINT) AS VARCHAR) AS band FROM customer) ON nation, segment, band INTO NAME col VALUE text)")
def unpivot_cells(spark, sf_dir):
    return tables.cells(_people(spark, sf_dir), "customer", "c_custkey").drop("source_id")


@query("SELECT c_custkey AS row, 'contact' AS col, 'line ' || CAST(c_custkey AS VARCHAR) AS text, 'pii::phone_number' AS entity_id, 0.88 AS confidence FROM customer WHERE c_custkey % 5 = 0")
def column_consensus(spark, sf_dir):
    n = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    t = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("line "), F.col("c_custkey"))).when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.concat(F.lit("(743) 555-"), n)).alias("contact"))
    cells = tables.cells(t, "customer", "c_custkey")
    found = detect.deterministic(cells, only("phone_number"))
    return tables.consensus(cells, found).select("row", "col", "text", "entity_id", F.round("confidence", 6).alias("confidence"))


@query("SELECT c_custkey, 'reach [PHONE] now' AS contact, c_mktsegment AS segment FROM customer")
def scrub_rows(spark, sf_dir):
    n = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    t = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("reach (743) 555-"), n, F.lit(" now")).alias("contact"), F.col("c_mktsegment").alias("segment"))
    rules = only("phone_number")
    plan = policy.execute(policy.resolve(detect.scan(tables.cells(t, "t", "c_custkey"), rules), rules))
    return tables.scrub_rows(t, plan, "c_custkey", "t")


_LADDER = {"age": "age", "zip": "zip", "segment": None}
_RUNG_SQL = {
    "age": ["CAST(a AS VARCHAR)", *(f"CASE WHEN a >= 90 THEN '90+' ELSE CAST(a - a % {w} AS VARCHAR) END" for w in (5, 10, 20)), "'*'"],
    "zip": ["z", "substr(z, 1, 3)", "substr(z, 1, 1)", "'*'"],
    "segment": ["c_mktsegment", "'*'"],
}


def _lattice_people(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).cast("string").alias("age"), F.lpad((F.col("c_custkey") * 37 % 100000).cast("string"), 5, "0").alias("zip"), F.col("c_mktsegment").alias("segment"))


@query(
    "WITH c AS (SELECT c_custkey % 100 AS a, lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') AS z, c_mktsegment FROM customer) "
    + " UNION ALL ".join(f"SELECT '{i},{j},{k}' AS node, {i + j + k} AS height, min(n) AS k, count(*) AS classes FROM (SELECT count(*) AS n FROM c GROUP BY {x}, {y}, {w})" for i, x in enumerate(_RUNG_SQL["age"]) for j, y in enumerate(_RUNG_SQL["zip"]) for k, w in enumerate(_RUNG_SQL["segment"]))
)
def lattice_nodes(spark, sf_dir):
    return optimize.lattice(_lattice_people(spark, sf_dir), _LADDER)


_VALUE_SQL = {
    "age": ["CAST(a AS VARCHAR)", *(f"CASE WHEN a >= 90 THEN '90+' ELSE CAST(a - a % {w} AS VARCHAR) || '-' || CAST(a - a % {w} + {w} - 1 AS VARCHAR) END" for w in (5, 10, 20)), "'*'"],
    "zip": ["z", "substr(z, 1, 3) || '**'", "substr(z, 1, 1) || '****'", "'*'"],
    "segment": ["c_mktsegment", "'*'"],
}
_STEPS = {c: ["keep", *(f"generalize:{x}" for x in G.LADDERS.get(k, ())), "mask"] for c, k in _LADDER.items()}


def _choice_sql(k: int) -> str:
    shape = lambda x: f"regexp_replace(regexp_replace({x}, '[A-Za-z]', 'A', 'g'), '[0-9]', 'D', 'g')"
    kept = " UNION ALL ".join(f"SELECT '{c}' AS c, {i} AS i, '{_STEPS[c][i]}' AS action, 1 - (0.2 * avg(CAST({x} <> {xs[0]} AS INT)) + 0.5 * (1 - count(DISTINCT {x}) / count(DISTINCT {xs[0]})) + 0.3 * avg(CAST({shape(x)} <> {shape(xs[0])} AS INT))) AS r FROM c" for c, xs in _VALUE_SQL.items() for i, x in enumerate(xs))
    nodes = " UNION ALL ".join(f"SELECT {i} AS age, {j} AS zip, {s} AS segment, min(n) AS k FROM (SELECT count(*) AS n FROM c GROUP BY {x}, {y}, {w})" for i, x in enumerate(_VALUE_SQL["age"]) for j, y in enumerate(_VALUE_SQL["zip"]) for s, w in enumerate(_VALUE_SQL["segment"]))
    return f"""WITH c AS (SELECT c_custkey % 100 AS a, lpad(CAST(c_custkey * 37 % 100000 AS VARCHAR), 5, '0') AS z, c_mktsegment FROM customer), kept AS ({kept}), nodes AS ({nodes}),
    ok AS (SELECT * FROM nodes WHERE k >= {k}), least AS (SELECT * FROM ok WHERE NOT EXISTS (SELECT 1 FROM ok b WHERE b.age <= ok.age AND b.zip <= ok.zip AND b.segment <= ok.segment AND (b.age, b.zip, b.segment) <> (ok.age, ok.zip, ok.segment))),
    best AS (SELECT least.* FROM least, kept x, kept y, kept w WHERE x.c = 'age' AND x.i = age AND y.c = 'zip' AND y.i = zip AND w.c = 'segment' AND w.i = segment ORDER BY round((x.r + y.r + w.r) / 3, 9) DESC, age + zip + segment, age, zip, segment LIMIT 1)
    SELECT kept.c AS column_name, action, best.k AS achieved_k, round(r, 6) AS retention FROM kept, best WHERE i = CASE kept.c WHEN 'age' THEN age WHEN 'zip' THEN zip ELSE segment END"""


@query(_choice_sql(optimize.PRESETS["balanced"].k))
def optimizer_choice(spark, sf_dir):
    people = _lattice_people(spark, sf_dir)
    chosen = optimize.choose(people, _LADDER, optimize.PRESETS["balanced"])
    kept = optimize.retentions(optimize.folded(people, _LADDER), _LADDER)
    rows = [(c, a, chosen.achieved_k, round(kept[c][_STEPS[c].index(a)], 6)) for c, a in sorted(chosen.actions.items())]
    return small(spark, rows, "column_name string, action string, achieved_k long, retention double")


#: entity, action under each profile
_POLICY = [
    ("pii::ssn", "mask", "hash"), ("pii::us_itin", "mask", "replace"), ("phi::dna_sequences", "mask", "replace"), ("phi::fingerprints", "mask", "replace"), ("fin::payment_transaction_id", "mask", "replace"), ("pii::dates", "generalize", "generalize"), ("pii::nationality", "mask", "generalize"), ("phi::vital_signs", "mask", "generalize"),
    ("phi::medical_condition", "mask", "keep"), ("phi::measurement_units", "keep", "keep"), ("pii::organization", "keep", "generalize"), ("pii::email_address", "mask", "replace"), ("phi::genomic_variants", "mask", "replace"), ("fin::credit_card_number", "mask", "format_preserve"),
]


@query(f"""WITH p(i, entity_id, hipaa_safe_harbor, gdpr_pseudonymization) AS (VALUES {", ".join(f"({i}, '{e}', '{h}', '{g}')" for i, (e, h, g) in enumerate(_POLICY))})
SELECT c_custkey, profile, entity_id, action FROM (UNPIVOT (SELECT c_custkey, entity_id, hipaa_safe_harbor, gdpr_pseudonymization FROM customer JOIN p ON c_custkey % {len(_POLICY)} = i) ON hipaa_safe_harbor, gdpr_pseudonymization INTO NAME profile VALUE action)""")
def policy_profiles(spark, sf_dir):
    ids = F.array(*[F.lit(e) for e, _, _ in _POLICY])
    f = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(ids, (F.col("c_custkey") % len(_POLICY) + 1).cast("int")).alias("entity_id"), F.col("c_name").alias("text"))
    out = [policy.resolve(f, catalogue(), p).select("c_custkey", F.lit(p).alias("profile"), "entity_id", "action") for p in policy.PROFILES]
    return out[0].unionByName(out[1])


_PRECISE = [("age", "34", 1.0), ("age", "30-34", 0.8), ("age", "30-39", 0.6), ("age", "20-39", 0.4), ("date", "2021-03-05", 1.0), ("date", "2021-03", 0.8), ("date", "2021", 0.6), ("date", "2020s", 0.4), ("zip", "02139", 1.0), ("zip", "021**", 0.6), ("zip", "0****", 0.3), ("coordinates", "42.36", 1.0), ("coordinates", "42.4", 0.6), ("coordinates", "42", 0.3)]


@query(f"""WITH p(i, kind, value, factor) AS (VALUES {", ".join(f"({i}, '{k}', '{v}', {f})" for i, (k, v, f) in enumerate(_PRECISE))}) SELECT c_custkey, kind, value, CAST(factor AS DOUBLE) AS factor FROM customer JOIN p ON c_custkey % {len(_PRECISE)} = i""")
def precision_factors(spark, sf_dir):
    """The ladders' own results go back in: what a rung leaves of a value's severity."""
    dim = small(spark, [(i, k, v) for i, (k, v, _) in enumerate(_PRECISE)], "i long, kind string, value string")
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(_PRECISE)).alias("i")).join(F.broadcast(dim), "i").select("c_custkey", "kind", "value", G.precision(F.col("kind"), F.col("value")).alias("factor"))


_OVER = {"email_address": "hash", "phone_number": "keep", "ip_address": "redact", "credit_card_number": "mask"}
_NEW = "CASE entity WHEN 'email_address' THEN 'EMAIL_' || substr(sha256(text), 1, 8) WHEN 'phone_number' THEN text WHEN 'ip_address' THEN '[IP_ADDRESS]' ELSE '[CREDIT_CARD]' END"


def planned(spark, sf_dir: str) -> DataFrame:
    return policy.execute(policy.resolve(assessed(spark, sf_dir), only(*FOUR), overrides=_OVER))


@query(f"SELECT entity, count(*) AS n, round(avg(0.2 * CAST(new <> text AS INT) + 0.5 * (1 - apart) + 0.3 * CAST(new <> text AS INT)), 6) AS loss FROM (SELECT f.*, {_NEW} AS new FROM {Q.found()} f) f JOIN (SELECT entity AS e, count(DISTINCT new) / count(DISTINCT text) AS apart FROM (SELECT *, {_NEW} AS new FROM {Q.found()}) GROUP BY entity) ON e = entity GROUP BY entity")
def utility_loss(spark, sf_dir):
    return utility.losses(planned(spark, sf_dir)).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("loss"), 6).alias("loss"))


@query(f"SELECT count(*) AS records, CAST(sum(l) AS BIGINT) AS leaking, round(avg(l), 6) AS rate FROM (SELECT doc_id, max(CAST(entity = 'phone_number' AS INT)) AS l FROM {Q.found()} GROUP BY doc_id)")
def leakage_rate(spark, sf_dir):
    return utility.leakage(planned(spark, sf_dir))


@query(f"SELECT doc_id, start, \"end\", entity, round(score0 * CASE entity WHEN 'email_address' THEN 0.15 WHEN 'phone_number' THEN 1 ELSE 0 END, 6) AS score FROM {_A}")
def residual_severity(spark, sf_dir):
    return utility.residual(planned(spark, sf_dir)).select(doc_id(), *_l("start", "end"), "entity", "score")


@query(f"SELECT action, count(*) AS n FROM (SELECT {'CASE entity ' + ' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _OVER.items()) + ' END'} AS action FROM {Q.found()}) GROUP BY action")
def plan_summary(spark, sf_dir):
    return policy.summary(planned(spark, sf_dir)).select("action", "n")


def _lines(spark, sf_dir: str) -> DataFrame:
    """One line for each number in an order; a number comes more than once."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")])


_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _gold(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    li = _lines(spark, sf_dir)
    start = F.col("l_linenumber") * 10
    off = F.when(F.col("l_partkey") % 3 == 0, 1).otherwise(0)
    g = li.select(F.col("l_orderkey").alias("doc"), start.alias("start"), (start + 5).alias("end"), F.col("l_returnflag").alias("entity_id"))
    p = li.select(F.col("l_orderkey").alias("doc"), (start + off).alias("start"), (start + off + 5).alias("end"), F.when(F.col("l_suppkey") % 4 == 0, "N").otherwise(F.col("l_returnflag")).alias("entity_id"))
    return g, p


_GP = f"""g AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS s, l_linenumber * 10 + 5 AS e, l_returnflag AS ent FROM {_LINES}),
p AS (SELECT l_orderkey AS doc, l_linenumber * 10 + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS s, l_linenumber * 10 + 5 + CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS e, CASE WHEN l_suppkey % 4 = 0 THEN 'N' ELSE l_returnflag END AS ent FROM {_LINES})"""
_STRICT = f"""WITH {_GP}, gc AS (SELECT doc, s, e, ent, count(*) AS n FROM g GROUP BY ALL), pc AS (SELECT doc, s, e, ent, count(*) AS n FROM p GROUP BY ALL),
j AS (SELECT coalesce(gc.ent, pc.ent) AS entity_id, coalesce(gc.n, 0) AS a, coalesce(pc.n, 0) AS b FROM gc FULL JOIN pc ON gc.doc = pc.doc AND gc.s = pc.s AND gc.e = pc.e AND gc.ent = pc.ent),
c AS (SELECT entity_id, CAST(sum(least(a, b)) AS BIGINT) AS tp, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS fp, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS fn FROM j GROUP BY entity_id)"""


@query(f"{_STRICT} SELECT * FROM c")
def strict_match(spark, sf_dir):
    return evaluate.strict(*_gold(spark, sf_dir))


@query(f"{_STRICT} SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def precision_recall(spark, sf_dir):
    return evaluate.prf(evaluate.strict(*_gold(spark, sf_dir)))


@query(f"WITH {_GP} SELECT g.ent AS gold_id, p.ent AS pred_id, count(*) AS n FROM g JOIN p ON g.doc = p.doc AND g.s < p.e AND p.s < g.e AND g.ent <> p.ent GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(*_gold(spark, sf_dir))


@query(f"WITH {_GP}, m AS (SELECT g.ent AS g, p.ent AS p FROM g JOIN p ON g.doc = p.doc AND g.s < p.e AND p.s < g.e) SELECT e AS entity_id, count(*) FILTER (g = e AND p = e) AS tp, count(*) FILTER (p = e AND g <> e) AS fp, count(*) FILTER (g = e AND p <> e) AS fn FROM m, (SELECT DISTINCT ent AS e FROM g UNION SELECT ent FROM p) GROUP BY e")
def overlap_match(spark, sf_dir):
    return evaluate.overlap(*_gold(spark, sf_dir)).groupBy("entity_id").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


def _runs(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two true spans side by side for each line; the found one covers both, is a bit too wide, or only has the first."""
    li = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 20).alias("at"), (F.col("l_partkey") % 3).alias("how"), F.col("l_returnflag").alias("entity_id"))
    g = li.select("doc", F.explode(F.array("at", F.col("at") + 5)).alias("start"), "entity_id").withColumn("end", F.col("start") + 5)
    p = li.select("doc", (F.col("at") - F.when(F.col("how") == 1, 1).otherwise(0)).alias("start"), (F.col("at") + F.when(F.col("how") == 2, 5).otherwise(10)).alias("end"), "entity_id", F.when(F.col("how") == 0, "llm").otherwise("ner").alias("winner_kind"))
    return g, p


_HOW = f"(SELECT l_returnflag AS entity_id, l_partkey % 3 AS how FROM {_LINES})"


@query(f"SELECT entity_id, CAST(sum(CASE how WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) AS BIGINT) AS tp, count(*) FILTER (how = 1) AS fp, CAST(sum(CASE how WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS BIGINT) AS fn FROM {_HOW} GROUP BY entity_id")
def strict_runs(spark, sf_dir):
    return evaluate.strict(*_runs(spark, sf_dir))


@query(f"SELECT CASE how WHEN 0 THEN 'llm' ELSE 'ner' END AS winner_kind, CAST(sum(CASE how WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) AS BIGINT) AS tp, count(*) FILTER (how = 1) AS fp FROM {_HOW} GROUP BY 1")
def winner_breakdown(spark, sf_dir):
    return evaluate.by_winner(evaluate.matches(*_runs(spark, sf_dir), exact=True))


@query(f"""WITH c AS (SELECT CAST(sum(CASE how WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END) AS DOUBLE) AS tp, count(*) FILTER (how = 1) AS fp, sum(CASE how WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS fn, 2.0 * count(*) FILTER (how = 0) AS own FROM {_HOW})
SELECT CAST(own AS BIGINT) AS tp, CAST(0 AS BIGINT) AS fp, CAST(1.0 AS DOUBLE) AS precision, round(own / (tp + fn), 4) AS recall_added, round(2 * tp / (2 * tp + fp + fn), 4) AS f1_with, round(2 * (tp - own) / (2 * (tp - own) + fp + fn + own), 4) AS f1_without, round(2 * tp / (2 * tp + fp + fn) - 2 * (tp - own) / (2 * (tp - own) + fp + fn + own), 4) AS gain FROM c""")
def llm_attribution(spark, sf_dir):
    return evaluate.attribution(evaluate.matches(*_runs(spark, sf_dir), exact=True))


@query()
def synthetic_quality(spark, sf_dir):
    """Precision, recall and F1 of the rules by entity, on a text for each customer whose values' places are known."""
    made, gold = synthetic.corpus(spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))))
    found = Scanner(spark).texts(made).withColumn("doc", F.col("source_id"))
    return evaluate.prf(evaluate.overlap(gold, found.where(F.col("entity_id").isin(*[e for e, _ in synthetic.values().values() if e]))))


@query(ORACLES["scan_email_address"])
def stream_findings(spark, sf_dir):
    """The scan as a stream over the documents, which ends when all of them are read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = f"{shared_dir(spark)}/{uuid.uuid4()}"
    found = stream.findings(spark.readStream.schema(docs.schema).parquet(f"{sf_dir}/documents.parquet*"), only("email_address"))
    found.select(doc_id(), *_l("start", "end"), "text").writeStream.format("parquet").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema("doc_id long, start long, end long, text string").parquet(f"{at}/out")
