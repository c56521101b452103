"""Sequence cleaning, construct stripping, composition and text scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tristage.functions import labels as L
from tristage.functions import text as T
from tristage.operators import stats as S
from tristage.operators import text as X
from tristage.operators.ordering import sample_rows
from tristage.operators.quality import corpus_share
from tristage.plans.bindings import DOCS_SQL
from tristage.plans.registry import query

_SPACES = r"\s+"
_LETTERS = f"^[{T.RESIDUES}]+$"


@query(
    "lang:s kind:s n:i n_chars:i",
    f"""WITH w AS (SELECT lang, upper(unnest(regexp_split_to_array(replace(text, 'ß', 'ss'), '{_SPACES}'))) AS s FROM documents)
    SELECT lang, CASE WHEN NOT regexp_full_match(s, '[{T.RESIDUES}]+') THEN 'foreign'
      WHEN length(s) >= 6 AND regexp_full_match(s, '[{T.NUCLEOTIDES}]+') THEN 'nucleotides' ELSE 'clean' END AS kind,
      count(*) AS n, sum(length(s)) AS n_chars FROM w WHERE s <> '' GROUP BY ALL""",
)
def cleaned_words(t):
    """Every word of every text checked against the alphabet and for nucleic acid letters."""
    words = t("documents").select("lang", F.explode(F.split("text", _SPACES)).alias("w")).where("w <> ''")
    s = T.squeeze(F.col("w"))
    kind = (
        F.when(T.clean_sequence(F.col("w"), reject_nucleotides=False) == "", "foreign")
        .when(T.looks_like_nucleotides(s, 6), "nucleotides").otherwise("clean")
    )
    return words.groupBy("lang", kind.alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.length(s)).alias("n_chars")
    )


@query(
    "id:i typed:s anyone:s",
    f"""WITH w AS (SELECT doc_id AS id, regexp_split_to_array(replace(text, 'ß', 'ss'), '{_SPACES}') AS a FROM documents),
    e AS (SELECT id, list_transform(a, lambda x: upper(x)) AS u FROM w),
    ok AS (SELECT id, list_filter(u, lambda x: regexp_full_match(x, '[{T.RESIDUES}]+')
        AND NOT (length(x) >= 30 AND regexp_full_match(x, '[{T.NUCLEOTIDES}]+'))) AS c FROM e)
    SELECT id, coalesce(list_filter(c, lambda x: length(x) % 3 <> 2)[1], c[1], '') AS typed,
      coalesce(c[1], '') AS anyone FROM ok""",
)
def first_valid_sequence(t):
    """First clean entry of the wanted or no type, else any clean one."""
    def entry(w):
        n = F.length(F.upper(w))
        kind = F.when(n % 3 == 0, "Protein").when(n % 3 == 1, "").otherwise("dna")
        return F.struct(kind.alias("kind"), w.alias("code"))

    entries = F.transform(F.split("text", _SPACES), entry)
    typed = T.first_typed_clean(entries, "kind", "code")
    return t("documents").select(
        F.col("doc_id").alias("id"), typed.alias("typed"),
        T.first_clean(F.split("text", _SPACES)).alias("anyone"),
    )


# What surrounds the content of a page, in the order it is removed.
PAGE_PATTERNS = [
    (r"<script>[\s\S]*?</script>", "script"),
    (r"<style>[\s\S]*?</style>", "style"),
    (r"<nav>[\s\S]*?</nav>", "navigation"),
    (r"<[^>]*>", "tag"),
    (r"&[a-z]+;", "entity"),
    (r"[#$%*]{3,}", "noise"),
    (r"\s{2,}", "blank run"),
]


def _nested_sql(col: str, patterns) -> str:
    for p, _ in patterns:
        col = f"regexp_replace({col}, '{p}', '', 'g')"
    return col


@query(
    "id:i n_chars:i text_md5:s",
    f"""SELECT page_id AS id, length(r) AS n_chars, md5(r) AS text_md5 FROM (
      SELECT page_id, CASE WHEN length(s) >= 20 THEN s ELSE html END AS r
      FROM (SELECT page_id, html, {_nested_sql('html', PAGE_PATTERNS)} AS s FROM pages))""",
)
def stripped_pages(t):
    stripped = T.strip_patterns(F.col("html"), PAGE_PATTERNS, 20)
    return t("pages").select(
        F.col("page_id").alias("id"), F.length(stripped).alias("n_chars"), F.md5(stripped).alias("text_md5")
    )


def _hits_sql(table: str, col: str, patterns) -> str:
    parts, running = [], col
    for i, (p, name) in enumerate(patterns):
        hits = f"len(regexp_extract_all({running}, '{p}'))"
        parts.append(
            f"SELECT {i} AS step, '{name}' AS pattern, sum({hits}) AS hits, sum(({hits} > 0)::INT) AS rows_hit FROM {table}"
        )
        running = f"regexp_replace({running}, '{p}', '', 'g')"
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE hits > 0"


@query("step:i pattern:s hits:i rows_hit:i", _hits_sql("pages", "html", PAGE_PATTERNS))
def page_strip_report(t):
    return X.strip_report(t("pages"), "html", PAGE_PATTERNS)


# RE2 has no lookahead; a leading GS followed by a capital is replaced by that capital.
_CONSTRUCT_SQL = "upper(replace(text, 'ß', 'ss'))"
for _p, _n in T.CONSTRUCT_PATTERNS[:-1]:
    _CONSTRUCT_SQL = f"regexp_replace({_CONSTRUCT_SQL}, '{_p}', '', 'g')"
_CONSTRUCT_SQL = f"regexp_replace({_CONSTRUCT_SQL}, '^GS([A-Z])', '\\1')"


@query(
    "lang:s n:i n_changed:i n_chars:i",
    f"""WITH c AS (SELECT lang, upper(replace(text, 'ß', 'ss')) AS u, {_CONSTRUCT_SQL} AS s FROM documents)
    SELECT lang, count(*) AS n, sum((s <> u)::INT) AS n_changed,
      sum(length(CASE WHEN length(s) >= 20 THEN s ELSE u END)) AS n_chars FROM c GROUP BY lang""",
)
def stripped_constructs(t):
    docs = t("documents").select("lang", F.upper("text").alias("u"))
    s = T.strip_patterns(F.col("u"), min_len=0)
    kept = T.strip_patterns(F.col("u"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(s != F.col("u")).alias("n_changed"),
        F.sum(F.length(kept)).alias("n_chars"),
    )


@query(
    "id:i " + " ".join(f"aa_{a}:d" for a in T.RESIDUES20),
    "SELECT doc_id AS id, " + ", ".join(
        f"(length(u) - length(replace(u, '{a}', ''))) / length(u) AS aa_{a}" for a in T.RESIDUES20
    ) + " FROM (SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS u FROM documents)",
)
def letter_composition(t):
    u = t("documents").select(F.col("doc_id").alias("id"), F.upper("text").alias("u"))
    return u.select("id", *T.composition(F.col("u")))


_SAMPLE_SQL = "SELECT * FROM documents ORDER BY sha256(concat_ws(':', doc_id, '0')), doc_id LIMIT {n}"
_SETS = {"disorder": T.DISORDER_PROMOTING, "hydrophobic": T.HYDROPHOBIC}


@query(
    "disorder:d hydrophobic:d",
    "SELECT " + ", ".join(
        f"sum(length(u) - length(translate(u, '{ls}', ''))) / sum(length(u)) AS {n}" for n, ls in _SETS.items()
    ) + f" FROM (SELECT upper(replace(text, 'ß', 'ss')) AS u FROM ({_SAMPLE_SQL.format(n=500)}))",
)
def sampled_letter_shares(t):
    """Letter-set shares of a fixed sample, the sampling operator's feature."""
    docs = t("documents").select("doc_id", F.upper("text").alias("u"))
    return corpus_share(docs, "u", _SETS, n=500, seed=0, id_col="doc_id")


@query(
    "id:i",
    "SELECT doc_id AS id FROM (" + _SAMPLE_SQL.replace("'0'", "'7'").format(n=100) + ")",
)
def fixed_sample(t):
    return sample_rows(t("documents").select("doc_id"), 100, 7, "doc_id").withColumnRenamed("doc_id", "id")


@query(
    "lang:s n:i truncated_share:d n_chars:i",
    """SELECT lang, count(*) AS n, avg((length(text) > 1022)::INT) AS truncated_share,
      sum(length(substr(text, 1, 1022))) AS n_chars FROM documents GROUP BY lang""",
)
def truncation_share(t):
    return t("documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.avg((F.length("text") > 1022).cast("int")).alias("truncated_share"),
        F.sum(F.length(F.substring("text", 1, 1022))).alias("n_chars"),
    )


@query(
    "key:s evidence:s n:i",
    """SELECT regexp_replace(p_brand || ' ' || p_name, '[^A-Za-z0-9]+', '_', 'g') AS key,
      'type=' || p_type || '|size=' || p_size AS evidence, count(*) AS n FROM part GROUP BY ALL""",
)
def evidence_strings(t):
    key = T.slug(F.concat_ws(" ", "p_brand", "p_name"))
    evidence = F.concat(F.lit("type="), F.col("p_type"), F.lit("|size="), F.col("p_size").cast("string"))
    return t("part").groupBy(key.alias("key"), evidence.alias("evidence")).agg(F.count("*").alias("n"))


@query(
    "id:i has_motif:b motif_head:b motif_tail:b starts_first:b",
    """SELECT doc_id AS id, regexp_matches(text, '[.,] [a-z]{2,3}e') AS has_motif,
      regexp_matches(substr(text, 1, 30), '[.,] [a-z]{2,3}e') AS motif_head,
      regexp_matches(right(text, 30), '[.,] [a-z]{2,3}e') AS motif_tail, starts_with(text, 'T') AS starts_first
    FROM documents""",
)
def motif_positions(t):
    return t("documents").select(
        F.col("doc_id").alias("id"), *T.motif_flags(F.col("text"), "[.,] [a-z]{2,3}e", 30, "T")
    )


_P = "'[A-Z][a-z]{2,4}\\.'"


@query(
    "center:s n:i exposure_rate:d head_share:d tail_share:d starts_first_rate:d median_all:d median_exposed:d"
    " median_unexposed:d median_delta:d mixed:b",
    f"""WITH f AS (SELECT source AS center, n_chars, regexp_matches(text, {_P}) AS m,
        regexp_matches(substr(text, 1, 30), {_P}) AS h, regexp_matches(right(text, 30), {_P}) AS ta,
        starts_with(text, 'T') AS st FROM documents),
    a AS (SELECT center, count(*) AS n, avg(m::INT) AS exposure_rate, avg(h::INT) AS hr, avg(ta::INT) AS tr,
        avg(st::INT) AS starts_first_rate, median(n_chars) AS median_all,
        median(n_chars) FILTER (m) AS median_exposed, median(n_chars) FILTER (NOT m) AS median_unexposed
      FROM f GROUP BY center HAVING count(*) >= 20)
    SELECT *, hr / nullif(exposure_rate, 0) AS head_share, tr / nullif(exposure_rate, 0) AS tail_share,
      median_exposed - median_unexposed AS median_delta, exposure_rate > 0.05 AND exposure_rate < 0.95 AS mixed FROM a""",
)
def exposure_profiles(t):
    flagged = t("documents").select(
        F.col("source").alias("center"), "n_chars",
        *T.motif_flags(F.col("text"), r"[A-Z][a-z]{2,4}\.", 30, "T"),
    )
    return S.exposure_profile(flagged, "center", "n_chars", min_n=20)


_NEEDLES = ["MIT License", "token ="]
_SCAN = T.scan_alternation(_NEEDLES).replace("\\ ", " ")


@query(
    "id:i n_hits:i first_hit:s",
    f"""SELECT doc_id AS id, len(h) AS n_hits, h[1] AS first_hit
    FROM (SELECT doc_id, regexp_extract_all(text, '{_SCAN}') AS h FROM documents) WHERE len(h) > 0""",
)
def sensitive_strings(t):
    return X.scan_patterns(t("documents"), "doc_id", "text", _NEEDLES).withColumnRenamed("doc_id", "id")


_NUMS = "list_filter(list_transform(regexp_extract_all(b, '\\d[\\d,]*\\.?\\d*'), lambda x: replace(rtrim(x, '.'), ',', '')), lambda x: x <> '')"


@query(
    "lang:s number:s only_in:s",
    f"""WITH n AS (SELECT DISTINCT lang, doc_id % 2 AS side, unnest({_NUMS}) AS number FROM (
        SELECT lang, doc_id, CASE WHEN instr(text, 'Released') > 0 THEN substr(text, instr(text, 'Released')) ELSE text END AS b
        FROM documents))
    SELECT lang, number, CASE WHEN min(side) = 0 THEN 'left' ELSE 'right' END AS only_in
    FROM n GROUP BY lang, number HAVING count(*) = 1""",
)
def number_differences(t):
    docs = t("documents")
    even, odd = docs.where(F.col("doc_id") % 2 == 0), docs.where(F.col("doc_id") % 2 == 1)
    return X.number_set_diff(even, odd, ["lang"], "text", "Released")
