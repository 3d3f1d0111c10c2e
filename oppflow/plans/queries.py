"""Queries over the given tables, one for each operator or job, and the DuckDB SQL that each is held against.

Stand-ins: ``pages`` are records (title, address, text), ``documents`` are posts
or record texts, ``orders`` lends them deadlines (order date), amounts (price)
and scores, ``events`` is what earlier runs have seen and the arrival log,
``lineitem`` holds several result rows for an order, ``part`` titles and funders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oppflow.functions import fixed, keys
from oppflow.functions.text import html_to_text, is_generic_title, normalize_for_match, normalize_text, qualify_title
from oppflow.operators import extract, history, merge, report, resolve, rules, score, segment
from oppflow.shared import spread, table
from oppflow.streaming.incremental import source_arrivals

AS_OF = "1997-06-01"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _day():
    return F.lit(AS_OF).cast("date")


def _list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _array(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _re(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


# Pages as records -----------------------------------------------------------------------------------------------------

_TEXT_SQL = r"""regexp_replace(regexp_replace(regexp_replace({c}, '(?is)<style\b.*?</style>', ' ', 'g'), '(?is)<script\b.*?</script>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"""


def _plain_sql(c: str) -> str:
    t = _TEXT_SQL.format(c=c)
    for name, ch in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
        t = f"replace({t}, '&{name};', '{ch}')"
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title, url, description`` of the pages."""
    title = html_to_text(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return spread(table(spark, sf_dir, "pages"), "page_id").select(F.col("page_id").alias("id"), title.alias("title"), "url", html_to_text(F.col("html")).alias("description"))


_RECORDS = rf"""
SELECT page_id AS id, {_plain_sql("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} AS title, url, {_plain_sql("html")} AS description FROM pages
"""

_DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
_PATH = r"regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_STRIP = "strip_accents(lower({t}))"
#: Keys of the records, as build_keys makes them (no title of the tables has a compatibility form).
_KEYS = rf"""
WITH r AS ({_RECORDS}),
p AS (
  SELECT *, {_DOMAIN} AS domain, {_PATH} AS path_text, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS segs,
         {"".join("regexp_replace(" for _ in fixed.GLOSSARY)}title{"".join(f", {_re(x)}, '{a}', 'i')" for a, x in fixed.GLOSSARY)} AS expanded
  FROM r
), q AS (
  SELECT *,
    regexp_replace(lower(domain || path_text), '/$', '') AS clean,
    CASE WHEN len(segs) >= 2 THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(array_to_string(segs, '/')), '\b20\d\d\b', '', 'g'), '-{{2,}}', '-', 'g'), '-/', '/', 'g'), '/-', '/', 'g'), '-$', '') ELSE '' END AS path,
    nullif(regexp_extract(title, '\b(20\d\d)\b', 1), '') AS year,
    domain <> '' AND domain NOT IN {_list(fixed.AGGREGATOR_HOSTS)} AND NOT regexp_matches(domain, '(^|\.)linkedin\.com$') AS own_host,
    regexp_extract_all(title, '\b([A-Z]{{3,}})\b', 1) AS caps,
    regexp_extract_all(expanded, '\b([A-Z]{{3,}})\b', 1) AS caps_expanded,
    regexp_replace(regexp_replace(regexp_replace({_STRIP.format(t="title")}, '\b20\d\d\b', '', 'g'), '^the\s+', ''), '[^a-z0-9]+', '', 'g') AS squash,
    list_filter(regexp_split_to_array(regexp_replace(regexp_replace({_STRIP.format(t="title")}, '\b\d\d\d\d\b', '', 'g'), '[^\w\s]', ' ', 'g'), '\s+'), lambda w: length(w) >= 4 AND w NOT IN {_list(fixed.TITLE_STOP)}) AS word_list, list_distinct(word_list) AS words,
    list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace({_STRIP.format(t="expanded")}, '\b20\d\d\b', '', 'g'), '[^a-z0-9]+'), lambda w: length(w) >= 3 AND w NOT IN {_list(fixed.RESIDUAL_FILLER)}))) AS residual
  FROM p
), k AS (
  SELECT *,
    CASE WHEN clean <> '' AND NOT regexp_matches(clean, {_re(fixed.UNINFORMATIVE_URL)}) THEN clean END AS key_url,
    CASE WHEN NOT regexp_matches(title, '[a-z]') AND len(caps) >= 3 THEN [] ELSE list_filter(caps, lambda a: a NOT IN {_list(fixed.GENERIC_ACRONYMS)}) END AS acronyms,
    CASE WHEN NOT regexp_matches(title, '[a-z]') AND len(caps) >= 3 THEN [] ELSE list_filter(caps, lambda a: a NOT IN {_list(fixed.GENERIC_ACRONYMS + fixed.INSTITUTION_ACRONYMS)}) END AS programs,
    CASE WHEN NOT regexp_matches(expanded, '[a-z]') AND len(caps_expanded) >= 3 THEN [] ELSE list_filter(caps_expanded, lambda a: a IN {_list([a for a, _ in fixed.GLOSSARY])}) END AS known,
    list_distinct(list_concat(words, list_filter(regexp_split_to_array(path, '[/-]'), lambda w: length(w) >= 4 AND w NOT IN {_list(fixed.TITLE_STOP)}))) AS all_words,
    list_filter({_array(fixed.VARIANT_MARKERS)}, lambda m: contains(squash || regexp_replace(clean, '[^a-z0-9]', '', 'g'), m)) AS variants
  FROM q
)
"""


def _jac(x: str) -> str:
    return f"coalesce(len(list_intersect(a.{x}, b.{x})) / nullif(len(list_distinct(list_concat(a.{x}, b.{x})))::DOUBLE, 0), 0)"


_VETO = f"""(a.domain = b.domain AND a.own_host AND a.path <> '' AND b.path <> '' AND a.path <> b.path AND NOT list_has_any(a.programs, b.programs)
   AND NOT (len(a.words) >= 2 AND len(b.words) >= 2 AND {_jac("words")} >= 0.8) AND {_jac("all_words")} < 0.5)"""
_RULE = f"""CASE WHEN a.key_url = b.key_url THEN 'url'
  WHEN {_VETO} OR a.variants <> b.variants OR a.year <> b.year THEN NULL
  WHEN a.domain = b.domain AND a.own_host AND a.domain NOT IN {_list(fixed.SHARED_HOSTS)} THEN 'host'
  WHEN (a.expanded <> a.title OR b.expanded <> b.title) AND list_has_any(a.known, b.known)
   AND list_filter(a.residual, lambda w: NOT list_contains(list_transform(list_intersect(a.known, b.known), lambda z: lower(z)), w)) = list_filter(b.residual, lambda w: NOT list_contains(list_transform(list_intersect(a.known, b.known), lambda z: lower(z)), w)) THEN 'glossary'
  WHEN length(a.squash) >= 12 AND a.squash = b.squash THEN 'squash'
  WHEN list_has_any(a.programs, b.programs) THEN 'acronym'
  WHEN len(a.words) >= 3 AND len(b.words) >= 3 AND {_jac("words")} >= 0.6 THEN 'words'
  WHEN len(a.words) = 2 AND list_sort(a.words) = list_sort(b.words) THEN 'two_words' END"""
_PAIRS = f"{_KEYS}, pairs AS (SELECT a.id AS id_a, b.id AS id_b, {_RULE} AS rule FROM k a, k b WHERE a.id < b.id)"


@query(rf"SELECT page_id, sha256({_plain_sql('html')}) AS text_sha256, length({_plain_sql('html')}) AS n FROM pages")
def page_text(spark, sf_dir):
    """P5: one-line text of every page."""
    t = html_to_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(t.cast("binary"), 256).alias("text_sha256"), F.char_length(t).cast("long").alias("n"))


@query(
    _KEYS
    + """SELECT id, clean, domain, path, year, squash, array_to_string(list_sort(words), ' ') AS words, array_to_string(acronyms, ' ') AS acronyms, array_to_string(programs, ' ') AS programs,
  CASE WHEN own_host THEN domain || '||' || coalesce(year, '') ELSE '|' || array_to_string((acronyms[:2] || word_list[:5])[:5], '-') || '|' || coalesce(year, '') END AS fingerprint FROM k"""
)
def record_keys(spark, sf_dir):
    """Identity keys of the records."""
    r = records(spark, sf_dir)
    t, u = F.col("title"), F.col("url")
    join = lambda c: F.array_join(c, " ")
    return r.select("id", keys.clean_url(u).alias("clean"), keys.url_domain(u).alias("domain"), keys.program_path_key(u).alias("path"), keys.year_of(t).alias("year"), keys.squash(t).alias("squash"), join(F.array_sort(keys.title_words(t))).alias("words"), join(keys.acronyms(t)).alias("acronyms"), join(keys.acronyms(t, True)).alias("programs"), keys.fingerprint(t, u, False).alias("fingerprint"))


@query(_PAIRS + "SELECT * FROM pairs WHERE rule IS NOT NULL")
def match_pairs(spark, sf_dir):
    """All pairs of records that are the same, and by which rule."""
    return resolve.match_pairs(records(spark, sf_dir)).withColumn("rule", F.col("rule"))


@query(
    _PAIRS
    + """, e AS (SELECT id_a AS u, id_b AS v FROM pairs WHERE rule IS NOT NULL UNION ALL SELECT id_b, id_a FROM pairs WHERE rule IS NOT NULL)
, walk AS (
  WITH RECURSIVE w AS (SELECT id, id AS node FROM k UNION SELECT w.id, e.v FROM w JOIN e ON e.u = w.node) SELECT id, min(node) AS cluster FROM w GROUP BY id
), s AS (
  SELECT k.id, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size,
         row_number() OVER (PARTITION BY cluster ORDER BY CASE WHEN url <> '' THEN 2 ELSE 0 END + CASE WHEN length(description) > 20 THEN 1 ELSE 0 END DESC, k.id) AS n
  FROM k JOIN walk ON walk.id = k.id
) SELECT id, cluster, cluster_size FROM s WHERE n = 1"""
)
def dedupe_records(spark, sf_dir):
    """The richest record of each cluster."""
    r = records(spark, sf_dir).withColumn("amount_max", F.lit(None).cast("double"))
    return resolve.dedupe(r).select("id", "cluster", "cluster_size")


@query(_KEYS + ", d AS (SELECT squash, any_value(words) AS words FROM k GROUP BY squash) SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM d) GROUP BY word")
def title_word_frequency(spark, sf_dir):
    """In how many distinct titles each word stands."""
    return resolve.word_frequency(resolve.build_keys(records(spark, sf_dir)))


def _seen(spark, sf_dir):
    """What earlier runs saw: the pages that events name, and their fingerprints."""
    first = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("ts").alias("first_seen"))
    ids = records(spark, sf_dir).join(first, "id").select("id", "title", "url", "first_seen")
    fp = keys.fingerprint(F.col("title"), F.col("url"))
    return ids, ids.select(fp.alias("fingerprint"), F.col("id").alias("record_id"), "title", "first_seen").filter(F.length("fingerprint") > 3)


_SEEN = f"""{_KEYS}, f AS (SELECT *, CASE WHEN own_host THEN domain || '||' || coalesce(year, '') ELSE '|' || array_to_string((acronyms[:2] || word_list[:5])[:5], '-') || '|' || coalesce(year, '') END AS fp FROM k),
first AS (SELECT user_id AS id, min(ts) AS first_seen FROM events GROUP BY user_id),
seen AS (SELECT f.*, first_seen FROM f JOIN first ON first.id = f.id),
alias AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY first_seen) AS n FROM seen WHERE length(fp) > 3) WHERE n = 1),
via AS (SELECT a.id, CASE WHEN s.id IS NOT NULL THEN 'same id' WHEN b.id IS NOT NULL AND NOT {_VETO} THEN 'same fingerprint' END AS via, s.first_seen AS id_seen, b.first_seen AS fp_seen
  FROM f a LEFT JOIN seen s ON s.id = a.id LEFT JOIN alias b ON b.fp = a.fp AND length(a.fp) > 3)
"""


@query(_SEEN + "SELECT id FROM via WHERE via IS NULL")
def new_records(spark, sf_dir):
    """Records that no earlier run has handled."""
    return history.split_seen(records(spark, sf_dir), *_seen(spark, sf_dir))[0].select("id")


@query(_SEEN + "SELECT id, via, CASE WHEN via = 'same id' THEN id_seen ELSE fp_seen END AS first_seen FROM via WHERE via IS NOT NULL")
def repeats_explained(spark, sf_dir):
    """Why the others were dropped, and when what they repeat was first seen."""
    return history.split_seen(records(spark, sf_dir), *_seen(spark, sf_dir))[1].select("id", "via", "first_seen")


@query(
    _KEYS
    + f""", first AS (SELECT DISTINCT user_id AS id FROM events), hit AS (SELECT DISTINCT a.id FROM k a, k b WHERE b.id IN (SELECT id FROM first) AND ({_RULE}) IS NOT NULL)
SELECT id FROM k WHERE id NOT IN (SELECT id FROM hit)"""
)
def unresearched(spark, sf_dir):
    """Records that match none of those already looked into."""
    r = records(spark, sf_dir)
    done = r.join(table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    return resolve.anti_match(r, done).select("id")


@query(
    _SEEN.rstrip()
    + f""", src AS (SELECT f.*, CASE WHEN o_totalprice > 300000 THEN 'APPLY_NOW' WHEN o_totalprice > 150000 THEN 'CONSIDER' ELSE 'SKIP' END AS tier, round(o_totalprice / 100000, 2) AS score, coalesce(o_orderpriority, '') AS angle FROM f JOIN orders ON o_orderkey = f.id),
tgt AS (SELECT src.*, CASE WHEN o_orderstatus = 'F' THEN 'SKIP' ELSE src.tier END AS old_tier FROM src JOIN first ON first.id = src.id JOIN orders ON o_orderkey = src.id),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY id) AS n FROM tgt WHERE length(fp) > 3) WHERE n = 1),
e AS (SELECT a.id, b.id AS page_id, b.old_tier <> a.tier OR abs(b.score - a.score) > 0.05 OR b.angle <> a.angle AS changed FROM src a JOIN exact b ON b.fp = a.fp WHERE NOT {_VETO}),
z AS (SELECT a.id, min(b.id) AS page_id FROM src a, tgt b WHERE a.id NOT IN (SELECT id FROM e) AND ({_RULE}) IS NOT NULL GROUP BY a.id)
SELECT src.id, coalesce(e.page_id, z.page_id) AS page_id, CASE WHEN e.page_id IS NOT NULL THEN CASE WHEN changed THEN 'update' ELSE 'unchanged' END WHEN z.page_id IS NOT NULL THEN 'merge' ELSE 'create' END AS action
FROM src LEFT JOIN e ON e.id = src.id LEFT JOIN z ON z.id = src.id"""
)
def upsert_actions(spark, sf_dir):
    """What happens to each scored record in the catalogue."""
    price = F.col("o_totalprice")
    tier = F.when(price > 300000, "APPLY_NOW").when(price > 150000, "CONSIDER").otherwise("SKIP")
    src = records(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("id") == F.col("o_orderkey")).select("id", "title", "url", tier.alias("tier"), F.round(price / 100000, 2).alias("final_score"), F.coalesce("o_orderpriority", F.lit("")).alias("angle"), "o_orderstatus", F.lit(False).alias("researched"), F.lit(False).alias("not_a_grant"))
    old = table(spark, sf_dir, "events").select(F.col("user_id").alias("id")).distinct()
    tgt = src.join(old, "id").select(F.col("id").alias("page_id"), "title", "url", F.when(F.col("o_orderstatus") == "F", "SKIP").otherwise(F.col("tier")).alias("tier"), F.col("final_score").alias("score"), "angle", "researched")
    return merge.classify_upsert(src.drop("o_orderstatus"), tgt).select("id", "page_id", "action")


@query(
    r"""WITH a AS (SELECT page_id, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(i) AS inner_html FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>', 2) AS i FROM pages)),
b AS (SELECT page_id, pos, href, """
    + _plain_sql("inner_html")
    + """ AS label FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY pos) AS n FROM b WHERE length(label) >= 3)
SELECT page_id, pos::INTEGER AS pos, href, label FROM c WHERE n = 1"""
)
def page_links(spark, sf_dir):
    """Links of every page, the first of each address."""
    return segment.page_links(table(spark, sf_dir, "pages")).drop("context")


# Documents as posts and record texts ------------------------------------------------------------------------------------


@query(r"SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS plain, sha256(strip_accents(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')))) AS bare FROM documents")
def text_forms(spark, sf_dir):
    """Normalised texts, with and without diacritics."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize_text(t).cast("binary"), 256).alias("plain"), F.sha2(normalize_for_match(t).cast("binary"), 256).alias("bare"))


@query(r"SELECT doc_id, sha256(coalesce(source, '') || '|' || trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS fingerprint FROM documents")
def post_fingerprints(spark, sf_dir):
    """Fingerprints of posts."""
    return table(spark, sf_dir, "documents").select("doc_id", keys.content_fingerprint(F.col("source"), F.col("text")).alias("fingerprint"))


@query(
    r"""WITH d AS (SELECT doc_id, source, text, sha256(coalesce(source, '') || '|' || trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))) AS fp FROM documents),
s AS (SELECT DISTINCT fp FROM d WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT DISTINCT fp AS fingerprint FROM d WHERE fp NOT IN (SELECT fp FROM s)"""
)
def new_posts(spark, sf_dir):
    """Posts that are not among those already labelled, each once."""
    docs = table(spark, sf_dir, "documents")
    fp = keys.content_fingerprint(F.col("source"), F.col("text"))
    seen = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(fp.alias("fingerprint"))
    return history.split_seen_posts(docs, seen, "source", "text")[0].select("fingerprint")


def _scored_records(spark, sf_dir):
    """Documents (the first line as title, the whole text) with an order's date as deadline and its price as amount."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    first = F.substring_index("text", "\n", 1)
    rows = docs.select(F.col("doc_id").alias("id"), first.alias("title"), F.col("text").alias("description"), F.col("lang").alias("country"), "source", F.lit("").alias("url"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("deadline_date"), F.col("o_totalprice").alias("amount_max"))
    return rows.join(o, "id", "left").withColumn("deadline_kind", F.when(F.col("deadline_date").isNull(), "unknown").otherwise("fixed")).withColumn("amount_min", F.lit(None).cast("double"))


def _profiles(spark):
    rows = [("north", "fr", ["de land", "es"], 50000.0, 200000.0, 80000.0, 120000.0, ["water_forest"], ["then", "onth"]), ("south", "es", ["en"], 1000.0, 400000.0, 10000.0, 300000.0, ["the_and"], ["para", "que"])]
    return spark.createDataFrame(rows, score.PROFILE)


_SCORED_RECORDS = "SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, text AS description, lang AS country, source, o_orderdate::DATE AS deadline_date, o_totalprice AS amount_max FROM documents LEFT JOIN orders ON o_orderkey = doc_id"


def _m(c: str, p: str) -> str:
    return f"regexp_matches({c}, {_re(p)}, 'i')"


_PLACES = r"\b(" + "|".join(p.replace(" ", r"[-\s]") for p in fixed.OTHER_PLACES) + r")\b"
_HARD = f"""CASE WHEN {_m("title", _PLACES)} AND NOT {_m("title", fixed.REGION)} THEN 'WRONG_GEOGRAPHY'
 WHEN {_m("title", fixed.SCHOLARSHIP)} THEN 'SCHOLARSHIP_ONLY'
 WHEN {_m("title", fixed.COURSE)} AND NOT {_m("title", "grant|fund|financ|award")} THEN 'COURSE_NOT_GRANT'
 WHEN {_m("title", fixed.OTHER_NOTICE)} AND NOT {_m("both_text", r"\b(call for|open call|apply by|deadline|convocatoria\s+abierta)\b")} THEN 'NOT_A_GRANT'
 WHEN {_m("both_text", fixed.VENTURE)} THEN 'VC_ONLY'
 WHEN {_m("title", fixed.NEWS_TITLE)} AND NOT {_m("both_text", "grant|fund|award|call|proposal|opportunit")} THEN 'NEWS_ARTICLE'
 WHEN {_m("title", fixed.NAME_ONLY)} AND NOT {_m("both_text", "call for|apply|deadline|submission|open|RFP|RFA")} THEN 'NO_SPECIFIC_OPPORTUNITY'
 WHEN {_m("both_text", fixed.CONFERENCE)} THEN 'CONFERENCE_NOT_GRANT'
 WHEN length(title) < 60 AND length(description) < 80 AND coalesce(amount_max, 0) = 0 AND deadline_date IS NULL AND NOT {_m("both_text", "grant|fund|apply|call|proposal|award|deadline|opportunit")} THEN 'NO_SPECIFIC_OPPORTUNITY'
 WHEN {_m("description", "appeared first on|this article originally appeared|read more at|originally published")} AND NOT {_m("both_text", "call for|apply|deadline|submission|open for|rfp|rfa|grant opportunity")} THEN 'NEWS_ARTICLE' END"""
_RULES_SQL = f"WITH r AS ({_SCORED_RECORDS}), b AS (SELECT *, title || ' ' || description AS both_text FROM r), h AS (SELECT *, {_HARD} AS hard FROM b)"


@query(_RULES_SQL + " SELECT id, hard AS reason FROM h WHERE hard IS NOT NULL")
def rejected_by_rules(spark, sf_dir):
    """records that can't be opportunities, and why."""
    r = _scored_records(spark, sf_dir)
    why = rules.ineligibility(F.col("title"), F.col("description"), F.coalesce("amount_max", F.lit(0)) != 0, F.col("deadline_date").isNotNull())
    return rules.apply_rules(r, why)[1].select("id", "reason")


@query(_RULES_SQL + " SELECT hard AS reason, count(*) AS n FROM h WHERE hard IS NOT NULL GROUP BY hard")
def reject_counts(spark, sf_dir):
    """A5: how often each reason applies."""
    return rules.reason_counts(rejected_by_rules(spark, sf_dir))


_SIZES = "[('north', 'fr', ['de', 'es'], 50000, 200000, 80000, 120000, ['water', 'forest', 'then', 'onth']), ('south', 'es', ['en'], 1000, 400000, 10000, 300000, ['the', 'and', 'para', 'que'])]"


def _word(c: str, w: str) -> str:
    return rf"regexp_matches({c}, '\b{w}\b')"


def _any_word(c: str, *ws: str) -> str:
    return "(" + " OR ".join(_word(c, w) for w in ws) + ")"


_PRESCORE = f"""{_RULES_SQL}, o AS (SELECT p.org, p.country AS home, p.willing, p.lo, p.hi, p.slo, p.shi, p.kw FROM (VALUES ('north', 'fr', ['de', 'es'], 50000, 200000, 80000, 120000, ['water', 'forest', 'then', 'onth']), ('south', 'es', ['en'], 1000, 400000, 10000, 300000, ['the', 'and', 'para', 'que'])) p(org, country, willing, lo, hi, slo, shi, kw)),
t AS (SELECT h.*, o.*, lower(title || ' ' || description || ' ' || coalesce(h.country, '')) AS txt, lower(title || ' ' || description) AS body, deadline_date - DATE '{AS_OF}' AS days FROM h, o),
g AS (SELECT *, strip_accents(txt) AS plain FROM t),
s AS (SELECT *,
  CASE WHEN regexp_matches(txt, '\\b' || home || '\\b') THEN 1.0 WHEN len(list_filter(willing, lambda w: regexp_matches(txt, '\\b' || w || '\\b'))) > 0 THEN 0.9
   WHEN {_any_word("plain", *fixed.CENTRAL)} THEN 0.85
   WHEN {_any_word("plain", *fixed.LATIN)} THEN 0.75
   WHEN {_any_word("plain", *fixed.WORLD)} THEN 0.6 ELSE 0.45 END AS geo,
  0.8 * CASE WHEN coalesce(amount_max, 0) = 0 THEN 0.65 WHEN amount_max < lo THEN 0.4 WHEN amount_max > hi * 5 THEN 0.2 WHEN amount_max > hi THEN 0.5 WHEN amount_max BETWEEN slo AND shi THEN 0.85 + 0.15 * (amount_max - slo) / (shi - slo) WHEN amount_max < slo THEN 0.75 ELSE 0.85 END AS size,
  0.7 * CASE WHEN days IS NULL THEN 0.75 WHEN days < 0 THEN 0 WHEN days < 15 THEN 0.2 WHEN days < 30 THEN 0.5 WHEN days < 60 THEN 0.8 ELSE 1 END AS dl,
  0.4 * CASE WHEN regexp_matches(body, {_re(fixed.ORG_NORTHERN)}) THEN 0.1 WHEN regexp_matches(body, {_re(fixed.ORG_YOUTH)}) THEN 1.0 WHEN regexp_matches(body, {_re(fixed.ORG_LOCAL)}) THEN 0.95 WHEN regexp_matches(body, {_re(fixed.ORG_SOUTHERN)}) THEN 0.9 ELSE 0.75 END AS org_type,
  0.3 * CASE WHEN regexp_matches(body, {_re(fixed.PARTNER_LEADS)}) THEN 0.4 WHEN regexp_matches(body, {_re(fixed.PARTNER_NEEDED)}) THEN 0.7 WHEN regexp_matches(body, {_re(fixed.PARTNER_OPTIONAL)}) THEN 0.95 ELSE 1 END AS partner,
  round(1.2 * least(len(list_filter(kw, lambda w: contains(body, w))) / 5.0, 1.0), 2) AS mission
  FROM g),
z AS (SELECT id, org, hard, geo, size, dl, mission, CASE WHEN hard IS NULL THEN days END AS days, CASE WHEN hard IS NULL THEN geo + size + dl + org_type + partner ELSE 0 END AS total FROM s)
""".replace("\\\\", "\\")


@query(_PRESCORE + "SELECT id, org, round(total, 3) AS total, days::INTEGER AS days_remaining, hard IS NULL AND days < 15 AS too_close, hard FROM z")
def prescore(spark, sf_dir):
    """Rule scores of every record for every organisation."""
    p = score.prescore(_scored_records(spark, sf_dir), _profiles(spark), _day())
    total = sum((F.col(f"scores.{x}") for x in ("geo", "size", "deadline", "org_type", "partnership")), F.lit(0.0))
    hard = F.filter("flags", lambda f: f != "DEADLINE_TOO_CLOSE")
    return p.select("id", "org", F.round(total, 3).alias("total"), "days_remaining", F.when(F.size(hard) > 0, False).otherwise(F.col("days_remaining") < 15).alias("too_close"), F.when(F.size(hard) > 0, F.get(hard, 0)).alias("hard"))


@query(
    _PRESCORE
    + """, w AS (SELECT *, CASE WHEN hard IS NOT NULL THEN 'INELIGIBLE' WHEN days < 15 THEN 'SKIP' WHEN total + mission >= 3.8 THEN 'APPLY_NOW' WHEN total + mission >= 3.2 THEN 'CONSIDER' WHEN total + mission >= 2.5 THEN 'MONITOR' ELSE 'SKIP' END AS tier
  FROM (SELECT * REPLACE (round(total, 2) AS total) FROM z)) SELECT org, tier, count(*) AS n FROM w GROUP BY org, tier"""
)
def tiers_by_organisation(spark, sf_dir):
    """Tiers after the keyword mission score."""
    base = _scored_records(spark, sf_dir)
    p = score.prescore(base, _profiles(spark), _day()).join(F.broadcast(_profiles(spark).select("org", "focus", "tags")), "org")
    mission = score.keyword_mission(F.col("title"), F.col("description"), F.col("focus"), F.col("tags"))
    done = p.withColumn("final_score", score.combine(F.col("prescore"), mission, F.lit(None).cast("double"), F.lit(None).cast("double")))
    return done.withColumn("tier", score.tier(F.col("final_score"), F.col("flags"))).groupBy("org", "tier").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def counts_by_source(spark, sf_dir):
    """A1: rows of each source."""
    return report.counts(table(spark, sf_dir, "documents"), "source")


@query("SELECT source, count(*) AS raw, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS repeats, count(*) FILTER (WHERE quality = 1) AS queued FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source")
def source_totals(spark, sf_dir):
    """A3: raw, repeated and queued rows of each source."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").withColumn("hit", F.lit(True)), "doc_id", "left")
    return report.source_counts(d.withColumn("is_repeat", F.coalesce("hit", F.lit(False))).withColumn("is_queued", F.coalesce(F.col("quality") == 1, F.lit(False))))


@query(
    rf"""WITH r AS (SELECT doc_id, source, regexp_matches(text, {_re(fixed.ROLLING)}, 'i') AS rolling, try_strptime(regexp_extract(text, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), '%Y-%m-%d') AS iso FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (WHERE rolling) AS rolling, count(*) FILTER (WHERE NOT rolling AND iso IS NOT NULL) AS iso_dated FROM r GROUP BY source"""
)
def rolling_and_dated(spark, sf_dir):
    """Rolling phrases and ISO dates in the texts of each source."""
    t = F.col("text")
    got = spread(table(spark, sf_dir, "documents"), "doc_id").select("source", extract.extract_deadline(t).alias("d"), F.try_to_date(F.nullif(F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).alias("iso"))
    kind = F.col("d.deadline_kind")
    return got.groupBy("source").agg(F.count("*").alias("n"), F.count_if(kind == "rolling").alias("rolling"), F.count_if((kind == "fixed") & F.col("iso").isNotNull()).alias("iso_dated"))


@query()
def extraction_coverage(spark, sf_dir):
    """Deadlines and amounts found in the texts of each source."""
    return extract.extraction_coverage(extract.extract_fields(spread(table(spark, sf_dir, "documents"), "doc_id")), "source")


@query()
def derived_titles(spark, sf_dir):
    """Titles and funders of the texts."""
    t = extract.derive_title(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("title"), extract.guess_funder(t).alias("funder"))


@query()
def post_segments(spark, sf_dir):
    """List posts as one row per item."""
    posts = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("post_id"), F.col("text").alias("post_text"))
    return segment.segment_posts(posts)


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS asked, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS \"end\" FROM conversations")
def nearest_title_line(spark, sf_dir):
    """The nearest earlier line of a kind, at most five up, and where the next block begins."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w.rowsBetween(-5, -1))
    return segment.next_start(table(spark, sf_dir, "conversations").withColumn("asked", asked), "conv_id", "turn").select("conv_id", "turn", "asked", "end")


_W = "regexp_extract_all(lower({c}), '([a-záéíóúñü0-9]+)', 1)"


def _sig(c: str) -> str:
    return f"list_filter({_W.format(c=c)}, lambda w: length(w) > 2 AND w NOT IN {_list(fixed.NAME_STOP)})"


@query(
    rf"""WITH t AS (SELECT p_partkey, trim(p_name) AS title, p_brand AS funder, p_type AS source FROM part),
u AS (SELECT *, len(list_filter({_W.format(c="title")}, lambda w: length(w) > 2 AND w NOT IN {_list(fixed.NAME_STOP + fixed.GENERIC_TITLE_WORDS)} AND NOT regexp_matches(w, '^\d+$'))) <= 1 AND title <> '' AS generic,
 length(trim(funder)) BETWEEN 3 AND 45 AND NOT regexp_matches(funder, '[|,;]') AND len({_W.format(c="funder")}) <= 6 AND len({_sig("funder")}) > 0 AND len(list_filter({_sig("funder")}, lambda w: NOT list_contains({_sig("source")}, w))) > 0 AS reliable,
 list_has_any({_sig("funder")}, {_W.format(c="title")}) OR contains(regexp_replace(lower(title), '[^a-z0-9áéíóúñü]', '', 'g'), regexp_replace(lower(funder), '[^a-z0-9áéíóúñü]', '', 'g')) OR contains(regexp_replace(lower(funder), '[^a-z0-9áéíóúñü]', '', 'g'), regexp_replace(lower(title), '[^a-z0-9áéíóúñü]', '', 'g')) AS named FROM t)
SELECT p_partkey, generic, CASE WHEN generic AND reliable AND NOT named THEN trim(funder) || ' — ' || title ELSE title END AS title FROM u"""
)
def qualified_titles(spark, sf_dir):
    """P20: titles that say too little, qualified by their funder."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", is_generic_title(F.col("p_name")).alias("generic"), qualify_title(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("title"))


# Orders as scored records ---------------------------------------------------------------------------------------------


def _catalogue(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = F.floor(F.pmod(F.col("o_totalprice"), F.lit(500))) / 100
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("page_id"), s.alias("score"), s.alias("final_score"), score.tier(s, F.array().cast("array<string>")).alias("tier"), (F.col("o_orderstatus") == "F").alias("near_miss_checked"), (F.col("o_orderstatus") == "P").alias("researched"), (F.col("o_orderpriority") == "1-URGENT").alias("pinned"), F.to_date("o_orderdate").alias("scan_date"), F.lit(None).cast("string").alias("url")).withColumn("recommendation", F.col("tier"))


_CATALOGUE = """WITH a AS (SELECT *, floor(o_totalprice % 500) / 100 AS score FROM orders),
c AS (SELECT o_orderkey AS id, o_orderkey AS page_id, score, CASE WHEN score >= 3.8 THEN 'APPLY_NOW' WHEN score >= 3.2 THEN 'CONSIDER' WHEN score >= 2.5 THEN 'MONITOR' ELSE 'SKIP' END AS tier, o_orderstatus = 'F' AS checked, o_orderstatus = 'P' AS researched, o_orderpriority = '1-URGENT' AS pinned, o_orderdate::DATE AS scan_date FROM a)
"""


@query(_CATALOGUE + "SELECT page_id, score FROM c WHERE tier = 'SKIP' AND score >= 2.0 AND score < 2.5 AND NOT checked ORDER BY score DESC, page_id LIMIT 8")
def near_miss(spark, sf_dir):
    """The work list just below the lowest tier."""
    return report.select_near_miss(_catalogue(spark, sf_dir))[0].select("page_id", "score")


@query(_CATALOGUE + "SELECT greatest(count(*) - 8, 0) AS remaining FROM c WHERE tier = 'SKIP' AND score >= 2.0 AND score < 2.5 AND NOT checked")
def near_miss_remaining(spark, sf_dir):
    """How many more there are."""
    return report.select_near_miss(_catalogue(spark, sf_dir))[1].select(F.col("remaining").cast("long").alias("remaining"))


@query(
    _CATALOGUE
    + f""", e AS (SELECT *, score + greatest(0, least(1.0, (DATE '{AS_OF}' - scan_date) / 7.0 * 0.15)) AS priority FROM c WHERE tier <> 'SKIP' AND NOT researched),
f AS (SELECT *, 0 AS slot FROM e WHERE pinned ORDER BY priority DESC, id LIMIT 2), g AS (SELECT * FROM f UNION ALL SELECT *, 1 FROM e WHERE id NOT IN (SELECT id FROM f))
SELECT id, slot, round(priority, 4) AS priority FROM g ORDER BY slot, priority DESC, id LIMIT 5"""
)
def research_list(spark, sf_dir):
    """Pinned first, then by score and waiting time."""
    c = _catalogue(spark, sf_dir).withColumn("stale", F.lit(False))
    return report.select_research(c, _day()).select("id", "slot", F.round("priority", 4).alias("priority"))


@query(_CATALOGUE + ", w AS (SELECT id, tier, count(*) OVER (PARTITION BY tier) AS tier_size, row_number() OVER (PARTITION BY tier ORDER BY score DESC, id) AS rank FROM c WHERE tier <> 'SKIP') SELECT * FROM w WHERE tier <> 'MONITOR' OR rank <= 10")
def tier_report(spark, sf_dir):
    """Rows of the report, the lowest tier capped."""
    return report.tier_report(_catalogue(spark, sf_dir)).select("id", "tier", "tier_size", "rank")


@query(_CATALOGUE + "SELECT id, score FROM c ORDER BY score DESC, id LIMIT 5")
def top_five(spark, sf_dir):
    """The five best."""
    return report.top_n(_catalogue(spark, sf_dir), 5).select("id", "score")


@query(_CATALOGUE + "SELECT id, row_number() OVER (ORDER BY CASE tier WHEN 'APPLY_NOW' THEN 0 WHEN 'CONSIDER' THEN 1 WHEN 'MONITOR' THEN 2 ELSE 3 END, score DESC, id) <= 100 AS leading FROM c")
def ranked(spark, sf_dir):
    """By tier, then score; the first hundred are marked."""
    c = _catalogue(spark, sf_dir)
    lead = report.rank_by(c, tier="tier").limit(100).select("id", F.lit(True).alias("l"))
    return c.join(lead, "id", "left").select("id", F.coalesce("l", F.lit(False)).alias("leading"))


@query(_CATALOGUE + "SELECT count(*) AS n, count(*) FILTER (WHERE tier = 'APPLY_NOW') AS apply_now, count(*) FILTER (WHERE tier = 'CONSIDER') AS consider, round(avg(score), 4) AS mean_score, max(score) AS best_score FROM c")
def run_totals(spark, sf_dir):
    """A4: totals of a run."""
    return report.run_totals(_catalogue(spark, sf_dir))


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate::DATE = DATE '1997-06-01'")
def researched_today(spark, sf_dir):
    """A10: rows of a day."""
    return report.researched_on(table(spark, sf_dir, "orders").withColumnRenamed("o_orderdate", "researched_at"), _day())


@query(
    f"""WITH a AS (SELECT *, o_orderdate::DATE - DATE '{AS_OF}' AS d, strftime(o_orderdate, '%b %-d, %Y') AS day FROM orders)
SELECT o_orderkey, CASE WHEN d < 0 THEN 'Closed (' || day || ')' WHEN d <= 14 THEN 'Urgent: ' || day || ' (' || d || 'd left)' WHEN d <= 45 THEN 'Soon: ' || day || ' (' || d || 'd)' ELSE 'Later: ' || day || ' (' || d || 'd)' END AS note,
 date_diff('day', o_orderdate::DATE, DATE '{AS_OF}') >= 90 AND abs(round(o_totalprice / 100000, 2) - 2.0) >= 0.5 AS stale FROM a"""
)
def deadline_notes(spark, sf_dir):
    """Notes on deadlines, and whether a verdict is stale."""
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", score.deadline_note(F.to_date("o_orderdate"), _day()).alias("note"), score.is_stale(F.to_date("o_orderdate").cast("timestamp"), F.lit(2.0), F.round(F.col("o_totalprice") / 100000, 2), _day()).alias("stale"))


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity / 100 AS geo, l_discount AS size, l_tax AS dl, l_discount + l_tax AS org FROM lineitem)
SELECT l_orderkey, l_linenumber, least(round(round(round(geo, 2) + round(size, 2) + round(dl, 2) + round(org, 2) + 0.3, 2) + 1.1 - 0.1 + 0.05, 2), 5.0) AS final_score FROM a"""
)
def breakdown_round_trip(spark, sf_dir):
    """Scores as text and back, with the judged parts replaced."""
    none = F.lit(None).cast("double")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 100).alias("geo"), F.col("l_discount").alias("size"), F.col("l_tax").alias("deadline"), (F.col("l_discount") + F.col("l_tax")).alias("org_type"))
    parts = {n: F.col(n) for n in ("geo", "size", "deadline", "org_type")} | {"partnership": F.lit(0.3), "mission_alignment": none, "competitive_fit": none, "strategic_fit": F.lit(0.05)}
    p = score.parse_breakdown(score.score_breakdown(parts, F.lit(1.0)))
    li = li.withColumn("p", p)
    rules_ = F.round(F.col("p.geo") + F.col("p.size") + F.col("p.deadline") + F.col("p.org_type") + F.col("p.partnership"), 2)
    return li.select("l_orderkey", "l_linenumber", score.combine(rules_, F.lit(1.1), F.lit(-0.1), F.col("p.strategic_fit")).alias("final_score"))


@query(
    """WITH l AS (SELECT l_orderkey AS id, l_linenumber::BIGINT * 1000000000000 + l_partkey * 100000 + l_suppkey AS rank, CASE WHEN l_discount > 0.05 THEN l_extendedprice END AS amount, CASE WHEN l_returnflag = 'N' THEN l_shipdate::DATE END AS dl, [l_returnflag, l_linestatus] AS themes FROM lineitem)
SELECT id, arg_min(amount, rank) FILTER (WHERE amount IS NOT NULL) AS amount_max, arg_min(dl, rank) FILTER (WHERE dl IS NOT NULL) AS deadline_date, array_to_string(list_sort(list_distinct(flatten(list(themes)))), ',') AS themes,
 CASE (count(amount) > 0)::INT + (count(dl) > 0)::INT WHEN 2 THEN 7 WHEN 1 THEN 2 ELSE 1 END AS ttl_days FROM l GROUP BY id"""
)
def merged_candidates(spark, sf_dir):
    """Several result rows per record in one."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 100_000 + F.col("l_suppkey")).alias("rank"), F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice")).alias("amount_max"), F.lit(None).cast("double").alias("amount_min"), F.when(F.col("l_returnflag") == "N", F.to_date("l_shipdate")).alias("deadline_date"), F.lit("unknown").alias("deadline_kind"), F.array("l_returnflag", "l_linestatus").alias("themes"))
    return merge.merge_candidates(rows).select("id", "amount_max", "deadline_date", F.array_join("themes", ",").alias("themes"), "ttl_days")


@query(
    """WITH c AS (SELECT l_orderkey AS k, max(l_extendedprice) AS hi, max(l_shipdate) AS fetched, min(l_shipdate)::DATE AS d FROM lineitem GROUP BY l_orderkey),
f AS (SELECT * FROM c WHERE epoch(TIMESTAMP '1997-06-01') - epoch(fetched) < 365 * 86400),
o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE END AS dl, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS amount FROM orders)
SELECT o.id, coalesce(dl, f.d) AS deadline_date, CASE WHEN coalesce(dl, f.d) IS NULL THEN 'rolling' ELSE 'fixed' END AS deadline_kind, CASE WHEN dl IS NULL OR amount IS NULL THEN coalesce(amount, f.hi) ELSE amount END AS amount_max FROM o LEFT JOIN f ON f.k = o.id"""
)
def filled_from_cache(spark, sf_dir):
    """Missing deadlines and amounts from a cache that is fresh enough."""
    cache = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("url")).agg(F.max("l_extendedprice").alias("amount_max"), F.max("l_shipdate").alias("fetched_at"), F.min(F.to_date("l_shipdate")).alias("deadline_date"))
    cache = cache.withColumn("deadline_kind", F.lit("fixed")).withColumn("amount_min", F.lit(None).cast("double"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), F.when(F.col("o_orderstatus") == "F", F.to_date("o_orderdate")).alias("deadline_date"), F.lit(None).cast("string").alias("deadline_kind"), F.lit(None).cast("double").alias("amount_min"), F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("amount_max"), F.lit("api").alias("type"))
    return merge.fill_from_cache(o, cache, 365, _day()).select(F.col("url").alias("id"), "deadline_date", "deadline_kind", "amount_max")


@query("SELECT o_orderkey AS id, 'orders' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT DISTINCT l_orderkey, 'lineitem' FROM lineitem WHERE l_returnflag = 'R'")
def replaced_by_key(spark, sf_dir):
    """Rows of some keys replaced by new ones."""
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("orders").alias("side"))
    new = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit("lineitem").alias("side")).distinct()
    return merge.replace_by_key(base, new, "id")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_of_each_key(spark, sf_dir):
    """The first row of each key in a stated order."""
    return history.first_wins(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT s_suppkey, s_acctbal, coalesce(n_name, 'none') AS country FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def source_defaults(spark, sf_dir):
    """A source's defaults where a row has none."""
    from oppflow.sources.landing import with_defaults

    none = lambda t: F.lit(None).cast(t)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("string").alias("source"), none("string").alias("country"), none("array<string>").alias("themes"), none("double").alias("amount_min"), none("double").alias("amount_max"))
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("source"), F.col("n_name").alias("country"), F.array("n_name").alias("themes"), F.lit(1.0).alias("amount_min"), F.lit(2.0).alias("amount_max"))
    return with_defaults(rows, d).select("s_suppkey", "s_acctbal", F.coalesce("country", F.lit("none")).alias("country"))


@query("SELECT c_custkey AS id, 'live' AS kind, c_nationkey AS source FROM customer UNION ALL SELECT s_suppkey, 'standing', s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def standing_rows(spark, sf_dir):
    """Standing rows of sources that have no live ones."""
    from oppflow.sources.landing import with_standing

    live = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("live").alias("kind"), F.col("c_nationkey").alias("source"))
    standing = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("standing").alias("kind"), F.col("s_nationkey").alias("source"))
    return with_standing(live, standing, True)


# Events as the arrival log --------------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def arrivals(spark, sf_dir):
    """Rows of each source and day."""
    return source_arrivals(table(spark, sf_dir, "events"), "ts", "event_type")


@query(
    """WITH d AS (SELECT user_id, date_trunc('day', ts) AS ran_at, count(*) FILTER (WHERE event_type <> 'error') AS fetched FROM events GROUP BY ALL)
SELECT user_id, ran_at, fetched, lag(fetched) OVER w AS previous, coalesce(lag(fetched) OVER w > 0 AND fetched = 0, false) AS dropped FROM d WINDOW w AS (PARTITION BY user_id ORDER BY ran_at)"""
)
def dropped_sources(spark, sf_dir):
    """Sources that had rows in the run before and have none now."""
    h = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("ran_at")).agg(F.count_if(F.col("event_type") != "error").alias("fetched"))
    return report.run_delta(h, "user_id").select("user_id", "ran_at", "fetched", "previous", "dropped")


@query("SELECT event_id FROM events WHERE date_trunc('day', ts) IN (SELECT DISTINCT date_trunc('day', ts) AS d FROM events ORDER BY d DESC LIMIT 10)")
def last_runs(spark, sf_dir):
    """Rows of the last ten runs."""
    h = table(spark, sf_dir, "events").withColumn("ran_at", F.date_trunc("day", "ts"))
    return report.keep_last(h, 10).select("event_id")


@query(
    """WITH s AS (SELECT event_type AS source, count(*) AS raw, count(*) FILTER (WHERE value < 1) AS repeats, count(*) FILTER (WHERE value >= 50) AS queued FROM events WHERE event_type <> 'view' GROUP BY event_type),
r AS (SELECT * FROM (VALUES ('orders', true, ['purchase', 'signup']), ('pages', true, ['view']), ('old', false, ['click'])) v(name, enabled, sources)),
n AS (SELECT name, enabled, unnest(sources) AS source FROM r)
SELECT name, CASE WHEN NOT enabled THEN 'off' WHEN count(raw) = 0 THEN 'missing' WHEN sum(raw) = 0 THEN 'empty' ELSE 'ok' END AS state, coalesce(sum(raw), 0)::BIGINT AS raw, coalesce(sum(repeats), 0)::BIGINT AS repeats, coalesce(sum(queued), 0)::BIGINT AS queued FROM n LEFT JOIN s ON s.source = n.source GROUP BY name, enabled
UNION ALL SELECT source, 'unregistered', raw, repeats, queued FROM s WHERE source NOT IN (SELECT source FROM n)"""
)
def source_health(spark, sf_dir):
    """The state of each registered source, and sources that nobody registered."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'view'")
    status = e.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("raw"), F.count_if(F.col("value") < 1).alias("repeats"), F.count_if(F.col("value") >= 50).alias("queued")).withColumn("ok", F.lit(True)).withColumn("error", F.lit(None).cast("string"))
    registry = spark.createDataFrame([("orders", True, ["purchase", "signup"]), ("pages", True, ["view"]), ("old", False, ["click"])], "name string, enabled boolean, sources array<string>")
    past = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("ran_at"), F.lit(1).alias("fetched")).filter("false")
    return report.run_report(status, registry, past).drop("dropped")


@query("SELECT source AS source_name, count(*) AS fetched, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS seen, count(*) FILTER (WHERE l.doc_id IS NULL) AS \"new\", count(*) FILTER (WHERE l.doc_id IS NULL AND lang = 'en') AS relevant FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source")
def feed_metrics(spark, sf_dir):
    """Fetched, seen, new and relevant posts of each page."""
    seen = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("is_seen", F.lit(True))
    d = table(spark, sf_dir, "documents").join(seen, "doc_id", "left").withColumn("is_seen", F.coalesce("is_seen", F.lit(False))).withColumn("is_relevant", F.col("lang") == "en")
    return report.feed_metrics(d.withColumnRenamed("source", "source_name"))


# Vectors --------------------------------------------------------------------------------------------------------------


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def similar_vectors(spark, sf_dir):
    """All pairs of similar vectors."""
    return resolve.similar_vectors(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), threshold=0.4).withColumn("score", F.round("score", 4))


@query()
def vector_candidates(spark, sf_dir):
    """Pairs of records to review."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return resolve.vector_candidates(records(spark, sf_dir).join(e, "id"))


# The whole scan -------------------------------------------------------------------------------------------------------


@query()
def scan_queue(spark, sf_dir):
    """The scan as one plan: what is worth judging, for each organisation."""
    from oppflow.plans.scan import scan

    r = records(spark, sf_dir).withColumn("source", keys.url_domain(F.col("url"))).withColumn("country", F.lit(None).cast("string"))
    out = scan(r, *_seen(spark, sf_dir), _profiles(spark), _day())
    return out["queued"].select("id", "org", "prescore")
