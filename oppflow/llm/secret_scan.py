"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

One pass over the texts finds candidates of each kind; the pieces between the
matches give their positions. Every candidate value is then known by its hash,
and the corpus says how many repositories and owners hold it: a value that many
owners hold is a copied example, one that a single owner holds and that looks
drawn at random is reported as live. The counts are combined in steps (value,
owner and repository; value and owner; value), each within tasks first, so a
value that a third of all rows hold needs no large group; the counts return to
the rows by a join in which such a value is salted.

Kinds: ``assign``, ``access`` and ``hex`` are the base ones; ``issued`` adds
tokens with an issuer's prefix, signed web tokens and private-key headers.

Defined results: null counts as empty; a text without secrets has zero counts,
the hash of the empty string and an empty span list; null owners and
repositories count as one owner or repository; repeated rows give a row each;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oppflow.operators.joins import salted_join
from oppflow.shared import materialize

#: (kind, pattern, group of the value, least characters of the value). Runs that are too short are no matches of hex and access at all.
#: Only single characters and character classes are repeated, and a long run is entered at its start alone, so a text that almost
#: matches costs neither stack nor quadratic time.
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("issued", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
]
BASE = 3
#: A value that at least so many owners hold is an example that they copied.
EXAMPLE_OWNERS = 3
#: Rows of one value, at least, from which on its join is dealt over several tasks.
HOT_ROWS = 50_000


def _matches(text: Column, kind: int) -> Column:
    """All matches of a kind: kind, gap before, length, whether it is long enough, value."""
    _, pattern, group, least = KINDS[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(whole), F.lit(1)))

    def row(x: Column) -> Column:
        ok = F.char_length(x["value"]) >= least
        return F.struct(F.lit(kind).alias("kind"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["whole"]).alias("len"), ok.alias("ok"), F.when(ok, x["value"]).alias("value"))

    found = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), row)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean,value:string>>"))


def _scan(text: Column) -> Column:
    return F.array(*[_matches(text, k) for k in range(len(KINDS))])


def _looks_live(value: Column) -> Column:
    """Enough different characters, letters or digits mixed, and no placeholder word."""
    chars = F.size(F.array_distinct(F.split(value, "")))
    return (chars >= 8) & value.rlike(r"\d") & value.rlike("[A-Za-z]") & ~value.rlike(r"(?i)example|sample|dummy|changeme|placeholder|xxxx|test|your[_-]?")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents (``row_id, id``) and their candidates (``row_id, kind, start, end, ok, hash, live_looking, repo, owner``)."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"))
    scanned = materialize(src.select(F.monotonically_increasing_id().alias("row_id"), "id", "repo", "owner", _scan(F.col("text")).alias("found")), "secrets")
    each = scanned.filter(F.exists("found", lambda f: F.size(f) > 0)).select("row_id", "repo", "owner", F.explode("found").alias("of_kind")).select("row_id", "repo", "owner", F.posexplode("of_kind").alias("at", "m"))
    upto = Window.partitionBy("row_id", "m.kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(upto)
    found = each.select("row_id", "repo", "owner", F.col("m.kind").alias("kind"), (end - F.col("m.len")).alias("start"), end.alias("end"), F.col("m.ok").alias("ok"), F.sha2(F.col("m.value").cast("binary"), 256).alias("hash"), _looks_live(F.col("m.value")).alias("live_looking"))
    return scanned.select("row_id", "id"), found.filter("ok")


def ownership(found: DataFrame) -> DataFrame:
    """For each value hash: the numbers of distinct repositories and owners that hold it, and of its rows."""
    held = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("rows"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("rows").alias("rows"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("rows").alias("rows"))


def with_ownership(found: DataFrame) -> DataFrame:
    """``found`` with ``owners`` and ``repos`` of its value; rows of a hot value are dealt by their row id."""
    counts = materialize(ownership(found), "owners")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    return salted_join(found, counts.select("hash", "owners", "repos"), "hash", F.col("row_id"), total, HOT_ROWS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per document: ``id`` and ``secrets``, an array of (start, kind, end, owners, repos, verdict), in order.

    Verdicts: ``example`` (held by many owners), ``live`` (by one owner, and looks random) or ``unclear``.
    """
    rows, found = candidates(docs, id_col, text_col, repo_col, owner_col)
    found = materialize(found, "candidates")
    verdict = F.when(F.col("owners") >= example_owners, "example").when((F.col("owners") == 1) & F.col("live_looking"), "live").otherwise("unclear")
    judged = with_ownership(found).select("row_id", F.struct("start", "kind", "end", "owners", "repos", verdict.alias("verdict")).alias("s"))
    listed = judged.groupBy("row_id").agg(F.array_sort(F.collect_list("s")).alias("secrets"))
    return rows.join(listed, "row_id", "left").select("id", F.coalesce("secrets", F.array().cast(listed.schema["secrets"].dataType)).alias("secrets"))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of the query."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    said = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    verdicts = lambda v: F.size(F.filter("secrets", lambda x: x["verdict"] == v)).cast("long")
    return scan(docs).select(
        F.col("id").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(said(F.filter("secrets", lambda x: x["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
        verdicts("live").alias("n_live"),
        verdicts("example").alias("n_example"),
    )
