"""Sequence and text functions, all inside code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Alphabets.
RESIDUES = "ACDEFGHIKLMNPQRSTVWYXBZUO"
RESIDUES20 = "ACDEFGHIKLMNPQRSTVWY"
NUCLEOTIDES = "ACGTUN"
MIN_NUCLEOTIDE_LENGTH = 30
DISORDER_PROMOTING = "PESQKRGAD"
HYDROPHOBIC = "AVLIMFWC"

# Construct residues and what they are; the order is the semantics.
CONSTRUCT_PATTERNS: list[tuple[str, str]] = [
    (r"H{6,}", "poly-histidine tag"),
    (r"DYKDDDDK", "FLAG tag"),
    (r"(?:DYKDDDDK){2,}", "tandem FLAG"),
    (r"EQKLISEEDL", "c-Myc tag"),
    (r"YPYDVPDYA", "HA tag"),
    (r"WSHPQFEK", "Strep-tag II"),
    (r"MASMTGGQQMG", "T7 tag"),
    (r"KETAAAKFERQHMDS", "S-tag"),
    (r"ENLYFQ[GS]?", "TEV site"),
    (r"LVPR[GS]{1,2}", "thrombin site"),
    (r"IEGR", "factor Xa site"),
    (r"DDDDK", "enterokinase site"),
    (r"SSGLVPRGSH", "pET-28 linker"),
    (r"GSGSGS(?:GS)*", "GS linker"),
    (r"(?:GGGGS){2,}", "GGGGS linker"),
    (r"^MGSSHHHHHHSSGLVPRGSH", "pET-28a leader"),
    (r"^MHHHHHH", "pET His leader"),
    (r"^MSYYHHHHHH", "MSYY-His leader"),
    (r"LEHHHHHH$", "pET-21 His tail"),
    (r"^GAMG", "BamHI residue"),
    (r"^GS(?=[A-Z])", "BamHI GS residue"),
]

# Generic host and address patterns that must not leave a private network.
PRIVATE_PATTERNS = [
    r"localhost", r"127\.0\.0\.1", r"192\.168\.\d+", r"10\.\d+\.\d+\.\d+",
    r"172\.(?:1[6-9]|2\d|3[01])\.\d+",
]
NUMBER = r"\d[\d,]*\.?\d*"


def squeeze(col: Column) -> Column:
    return F.upper(F.regexp_replace(col, r"\s+", ""))


def looks_like_nucleotides(col: Column, min_len: int = MIN_NUCLEOTIDE_LENGTH) -> Column:
    return (F.length(col) >= min_len) & col.rlike(f"^[{NUCLEOTIDES}]+$")


def clean_sequence(col: Column, alphabet: str = RESIDUES, reject_nucleotides: bool = True) -> Column:
    """Upper-case sequence without blanks; empty when outside the alphabet or nucleic."""
    s = squeeze(F.coalesce(col, F.lit("")))
    ok = s.rlike(f"^[{re.escape(alphabet)}]+$")
    if reject_nucleotides:
        ok = ok & ~looks_like_nucleotides(s)
    return F.when(ok, s).otherwise("")


def first_clean(codes: Column) -> Column:
    """First usable sequence of an array of strings."""
    cleaned = F.transform(codes, lambda c: clean_sequence(c))
    return F.coalesce(F.get(F.filter(cleaned, lambda s: s != ""), F.lit(0)), F.lit(""))


def first_typed_clean(entries: Column, kind: str, code: str, wanted: str = "protein") -> Column:
    """First usable code whose type is empty or the wanted one, else any usable code."""
    def typed(e: Column) -> Column:
        t = F.lower(F.trim(F.coalesce(e[kind], F.lit(""))))
        return (t == "") | (t == wanted)

    own = first_clean(F.transform(F.filter(entries, typed), lambda e: e[code]))
    anyone = first_clean(F.transform(entries, lambda e: e[code]))
    return F.coalesce(F.nullif(own, F.lit("")), anyone, F.lit(""))


def strip_patterns(
    col: Column, patterns: list[tuple[str, str]] = CONSTRUCT_PATTERNS, min_len: int = 20
) -> Column:
    """Remove the patterns in order; a result shorter than ``min_len`` keeps the original."""
    out = col
    for pattern, _ in patterns:
        out = F.regexp_replace(out, pattern, "")
    return F.when(F.length(out) >= min_len, out).otherwise(col)


def pattern_hits(
    col: Column, patterns: list[tuple[str, str]] = CONSTRUCT_PATTERNS
) -> list[tuple[str, Column]]:
    """(name, hit count) per pattern, each counted on what the earlier ones left."""
    out, hits = col, []
    for pattern, name in patterns:
        hits.append((name, F.regexp_count(out, F.lit(pattern))))
        out = F.regexp_replace(out, pattern, "")
    return hits


def letter_count(col: Column, letter: str) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(letter), F.lit("")))


def composition(col: Column, letters: str = RESIDUES20) -> list[Column]:
    """Letter frequencies, all 0 for the empty text."""
    n = F.length(col)
    return [
        F.when(n > 0, letter_count(col, a) / n).otherwise(0.0).alias(f"aa_{a}") for a in letters
    ]


def letter_set_count(col: Column, letters: str) -> Column:
    return F.length(col) - F.length(F.translate(col, letters, ""))


def has_motif(col: Column, pattern: str) -> Column:
    return col.rlike(pattern)


def motif_flags(col: Column, pattern: str, window: int = 30, first: str = "M") -> list[Column]:
    """Motif anywhere, in the first and in the last ``window`` letters, and the start letter."""
    return [
        col.rlike(pattern).alias("has_motif"),
        F.substring(col, 1, window).rlike(pattern).alias("motif_head"),
        F.right(col, F.lit(window)).rlike(pattern).alias("motif_tail"),
        col.startswith(first).alias("starts_first"),
    ]


def slug(col: Column) -> Column:
    return F.regexp_replace(col, r"[^A-Za-z0-9]+", "_")


def scan_alternation(needles: list[str] | None) -> str:
    """One pattern for the generic and the given needles.

    A missing list is an error, because a scan without needles would pass silently; an empty list
    is an explicit statement.
    """
    if needles is None:
        raise ValueError("the list of needles is missing; pass [] to scan generic patterns only")
    return "|".join([*PRIVATE_PATTERNS, *[re.escape(n) for n in needles]])


def numbers_of(col: Column) -> Column:
    """Number tokens of a text, without thousands separators and trailing full stops."""
    raw = F.regexp_extract_all(col, F.lit(f"({NUMBER})"), F.lit(1))
    plain = F.transform(raw, lambda x: F.regexp_replace(F.rtrim(x, F.lit(".")), ",", ""))
    return F.filter(plain, lambda x: x != "")


def body_after(col: Column, heading: str) -> Column:
    """The text from the heading on; the whole text when it does not occur."""
    at = F.regexp_instr(col, F.lit(heading))
    return F.when(at > 0, F.substring(col, at, F.length(col))).otherwise(col)
