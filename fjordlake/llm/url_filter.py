"""URL filters: a weighted vocabulary found by Aho-Corasick, behind explicit host and path rules.

Every term occurrence in the url (A-Z lower-cased) must stand between boundaries (no ASCII letter or digit
beside it). One strict term rejects a url; so do `soft_limit` different soft terms. Rules on host and
path come first; the longest that fits decides.

Defined cases: a null url, or one without "://", has empty host and path, so no rule fits it, and no
vocabulary hit unless its text has one (null: none; verdict allow). Repeated rows are judged alike.
Columns of the input that bear a result's name (host, path, rule, verdict, n_strict, soft_terms, in any
case) give way to the result, unless the url itself lies there: then its column is kept under `_url`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import table

STRICT_TERMS = ("porn", "xxx", "escort", "viagra", "warez", "casino", "spam-farm", "malware")
SOFT_TERMS = ("cheap", "pills", "spam", "farm", "free", "bonus", "bet", "adult", "click", "win", "loan", "crack", "hot")
SOFT_LIMIT = 2
#: (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def automaton(strict=STRICT_TERMS, soft=SOFT_TERMS):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(term, (term, False))
    for term in strict:
        a.add_word(term, (term, True))
    a.make_automaton()
    return a


_LOWER = {c: c + 32 for c in range(65, 91)}
RESULTS = ("host", "path", "rule", "n_strict", "soft_terms", "verdict")


def _inner(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def term_hits(a, url: str) -> tuple[int, set[str]]:
    """Number of strict occurrences, and the different soft terms, between boundaries."""
    low, n_strict, soft = url.translate(_LOWER), 0, set()
    for end, (term, is_strict) in a.iter(low):
        start = end + 1 - len(term)
        if (start and _inner(low[start - 1])) or (end + 1 < len(low) and _inner(low[end + 1])):
            continue
        if is_strict:
            n_strict += 1
        else:
            soft.add(term)
    return n_strict, soft


def vocabulary_hits(df: DataFrame, url_col: str = "url", strict=STRICT_TERMS, soft=SOFT_TERMS) -> DataFrame:
    """df with n_strict (int), soft_terms (array of different terms, sorted), in one Arrow pass."""
    schema = StructType([*df.schema.fields, StructField("n_strict", IntegerType()), StructField("soft_terms", ArrayType(StringType()))])
    at = df.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(strict, soft)
        for b in batches:
            found = [term_hits(a, u or "") for u in b.column(at).to_pylist()]
            cols = [*b.columns, pa.array([n for n, _ in found], pa.int32()), pa.array([sorted(s) for _, s in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "n_strict", "soft_terms"])

    return df.mapInArrow(run, schema)


def url_parts(url):
    """Columns (host, path): host after the first "://" up to / ? # or the end, A-Z lower-cased;
    path from there up to ? # or the end."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(df: DataFrame, url_col: str = "url", rules=RULES, strict=STRICT_TERMS, soft=SOFT_TERMS, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """df with host, path, rule (null where none fits), n_strict, soft_terms and verdict."""
    if url_col.lower() in RESULTS:
        df, url_col = df.drop("_url").withColumnRenamed(url_col, "_url"), "_url"
    df = df.drop(*(c for c in df.columns if c.lower() in RESULTS))
    host, path = url_parts(F.col(url_col))
    out = vocabulary_hits(df, url_col, strict, soft).withColumn("host", host).withColumn("path", path)
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, ruled = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(ruled)
    own = F.when((F.col("n_strict") >= 1) | (F.size("soft_terms") >= soft_limit), "block").otherwise("allow")
    return out.withColumn("rule", rule).withColumn("verdict", F.coalesce(ruled, own))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", F.col("n_strict"), F.size("soft_terms").alias("n_soft"))


def _sql() -> str:
    hit = lambda t: f"regexp_matches(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    count = lambda terms: " + ".join(f"({hit(t)})::INT" for t in terms)
    # Occurrences of a strict term that may share a boundary character: look-around free, so counted
    # by splitting each boundary character in two first.
    doubled = "regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([^a-z0-9])', '\\1\\1', 'g')"
    occ = lambda t: f"len(regexp_extract_all({doubled}, '(^|[^a-z0-9]){t.replace('-', '--')}($|[^a-z0-9])'))"
    strict = " + ".join(occ(t) for t in STRICT_TERMS)
    fits = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{v}|{h}{p}}}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"""
WITH u AS (
  SELECT page_id, url, {strict} AS n_strict, {count(SOFT_TERMS)} AS n_soft,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT *, CASE{fits} END AS got FROM u)
SELECT page_id, host, path, regexp_extract(got, '\\|(.*)\\}}$', 1) AS rule,
  coalesce(regexp_extract(got, '^\\{{(\\w+)\\|', 1), CASE WHEN n_strict >= 1 OR n_soft >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  n_strict::INT AS n_strict, n_soft::INT AS n_soft
FROM r"""


SQL = _sql()
